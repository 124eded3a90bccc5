"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of some documents in ascending doc_id order (null ids last). Layout, little endian:

    magic "GLTK", u16 version, u8 bits, u8 zero, u64 documents, u64 ids, u32 ids per block, u32 blocks
    i64 doc_id of each document (null: -2**63)
    u64 end of each document, counted in ids from the start of the file
    u64 byte offset of each block in the payload, and the payload's length
    payload: each id in ``bits`` bits, lowest bit first; every block starts at a byte

``bits`` is the least number that holds the vocabulary. :func:`unpack` reads any range of ids by
unpacking only its blocks, in numpy.

A file is written by one task to a name of its own and then renamed, so that a task that runs again or
twice leaves the same file. File systems are those of ``pyarrow.fs`` (local, HDFS, S3, GCS, ...).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .encoding import encoder
from .ranges import plan_ranges, running_sum

HEAD = struct.Struct("<4sHBBQQII")
NO_ID = -(1 << 63)
BLOCK_IDS = 1 << 16
SHARD_TEXT_BYTES = 24 << 20
SHARD_IDS = 6 << 20


def bits_of(vocabulary: int) -> int:
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    b = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(b.ravel(), bitorder="little").tobytes()


def unpack_block(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    b = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = b
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def file_bytes(doc_ids: list[int | None], docs: list[np.ndarray], vocabulary: int, block: int = BLOCK_IDS) -> bytes:
    bits = bits_of(vocabulary)
    ends = np.cumsum([len(d) for d in docs], dtype="<u8")
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    if len(ids) and int(ids.max()) >= max(1, vocabulary):
        raise ValueError(f"id {int(ids.max())} is not below the vocabulary size {vocabulary}")
    parts = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)], dtype="<u8")
    head = HEAD.pack(b"GLTK", 1, bits, 0, len(docs), len(ids), block, len(parts))
    keys = np.array([NO_ID if i is None else i for i in doc_ids], "<i8")
    return b"".join((head, keys.tobytes(), ends.tobytes(), offsets.tobytes(), *parts))


class TokenFile:
    """A file's bytes, opened: ``doc_ids``, ``ends``, and :meth:`ids` of any range."""

    def __init__(self, raw: bytes):
        magic, version, self.bits, _, n, self.n_ids, self.block, blocks = HEAD.unpack_from(raw)
        if magic != b"GLTK" or version != 1:
            raise ValueError("not a token file of version 1")
        at = HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.ends = np.frombuffer(raw, "<u8", n, at + 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 16 * n).astype(np.int64)
        self.raw, self.base = memoryview(raw), at + 16 * n + 8 * (blocks + 1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        got = [unpack_block(self.raw[self.base + self.offsets[k] : self.base + self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file, ids; blocks are unpacked one after another."""
        begin, kept, kept_at = 0, np.empty(0, np.uint32), 0
        for key, end in zip(self.doc_ids.tolist(), self.ends.tolist(), strict=True):
            if end - kept_at > len(kept):
                upto = min(self.n_ids, -(-end // self.block) * self.block)
                kept, kept_at = np.concatenate((kept[begin - kept_at :], self.ids(kept_at + len(kept), upto))), begin
            yield (None if key == NO_ID else key), begin, kept[begin - kept_at : end - kept_at]
            begin = end


def _put(uri: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, f"{path}/{name}")


def _get(uri: str, name: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(f"{path}/{name}") as src:
        return src.read()


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_text_bytes: int = SHARD_TEXT_BYTES, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes whole texts and writes them to ``uri`` in ascending ``id_col`` order over numbered files.

    Ids come from ``tokenizer`` (a file of the tokenizers library) without added special tokens; each
    document ends with ``end_id``. A null text is empty, a null id comes last, rows that share an id
    stay together in unspecified order, an empty table gives no files, other columns are ignored.
    Returns a saved table of the files: file, docs, ids and start (ids of all files before).

    Texts are encoded where they are read; ids, compressed, are what is shuffled, each range of ids to a partition of its own. Ranges hold about
    ``shard_text_bytes`` of text (more beyond 65,536 ranges), also if a third of all rows share an id or have none; a task begins a new file at ``shard_ids``, which bounds its memory.
    """
    C.text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    sizes = C.saved(base.select("k", (F.coalesce(F.octet_length("t"), F.lit(0)) + 32).cast("long").alias("w")))
    plan = plan_ranges(sizes, shard_text_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze, seen = encoder(tokenizer), zstandard.ZstdCompressor(1), 0
        tail = np.array([] if end_id is None else [end_id], enc.dtype).tobytes()
        for b in batches:
            keys, texts = (b.column(b.schema.get_field_index(c)) for c in ("k", "t"))
            turn = C.mix(np.arange(seen, seen + len(keys), dtype=np.uint64)) & np.uint64(0xFFFF)  # spreads the rows of an id
            where = pa.array(shared.value.ranks(keys, turn).astype(np.int32))
            seen += len(keys)
            for a in range(0, len(keys), 2_000):
                got = [squeeze.compress(ids.tobytes() + tail) for ids in enc.encode(texts.slice(a, 2_000).to_pylist())]
                yield C.batch(b=where.slice(a, 2_000), k=keys.slice(a, 2_000), z=pa.array(got, pa.binary()))
        C.release()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, expand = encoder(tokenizer), zstandard.ZstdDecompressor()
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        at, part, held = None, 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{at:08d}-{part:06d}.gltk"
            _put(uri, name, file_bytes(keys, ids, enc.size))
            return C.batch(file=[name], b=pa.array([at], pa.int32()), part=pa.array([part], pa.int32()), docs=[len(keys)], ids=[held])

        for bs, ks, zs in C.rows_of(batches, "b", "k", "z"):
            for b, k, z in zip(bs, ks, zs, strict=True):
                if keys and (b != at or held >= shard_ids):
                    yield flush()
                    part = part + 1 if b == at else 0
                    ids, keys, held = [], [], 0
                at = b
                ids.append(np.frombuffer(expand.decompress(z), enc.dtype))
                keys.append(k)
                held += len(ids[-1])
        if keys:
            yield flush()

    coded = base.mapInArrow(encode, "b int, k long, z binary")
    laid = coded.repartitionById(plan.size, F.col("b")).sortWithinPartitions("b", F.col("k").asc_nulls_last())
    files = C.saved(laid.mapInArrow(write, "file string, b int, part int, docs long, ids long"))
    return running_sum(files, [F.col("b"), F.col("part")], "ids", "start", keep=["file", "docs", "ids"])


def read_token_files(files: DataFrame, uri: str, digest: Callable[[np.ndarray], int] = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files that :func:`write_token_files` lists. A task
    holds one file at a time."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, starts in C.rows_of(batches, "file", "start"):
            for name, base in zip(names, starts, strict=True):
                rows = [(k, base + s, len(ids), digest(ids)) for k, s, ids in TokenFile(_get(uri, name)).documents()]
                yield C.batch(**{c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*rows, strict=True), strict=True)})

    spread = files.select("file", "start").repartition(min(max(1, files.count()), 100_000))
    return spread.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, uri = C.documents(spark, sf_dir), C.shared_dir(spark)
    return read_token_files(write_token_files(docs, uri, public_tokenizers.path("byte_bpe_50k.json")), uri)
