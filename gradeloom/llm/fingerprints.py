"""Document fingerprints by one-permutation MinHash.

The hashes of a text's runs of five words are binned once by their top bits, and each bin keeps its
least hash. An empty bin takes the value of a bin drawn by a 2-universal sequence of its own (optimal
densification), so that all bins stay comparable. Of each value ``b`` low bits are stored, packed. Two unrelated values agree
in ``b`` bits with chance 2**-b, which the estimate of the likeness takes off.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .ranges import plan_ranges

BINS, BITS = 256, 8
PART_TEXT_BYTES = 24 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.lru_cache(4096)
def _turn(turn: int, bins: int) -> np.ndarray:
    """The bin that each empty bin looks at in a turn."""
    return (C.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """A value for each bin from hashes in any order, repeated or not; None without any."""
    if not len(hashes):
        return None
    at = (hashes >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    if bins & (bins - 1):
        at %= bins
    out, full = np.full(bins, _EMPTY), np.zeros(bins, bool)
    np.minimum.at(out, at, hashes)
    full[at] = True
    out = C.mix(out)
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):
        turn += 1
        to = _turn(turn, bins)[empty]
        hit = full[to]
        out[empty[hit]] = out[to[hit]]
        empty = empty[~hit]
    return out


def packed(values: np.ndarray | None, bits: int = BITS) -> bytes:
    """The low ``bits`` of each value; no bytes for a text without words."""
    if values is None:
        return b""
    low = (values & np.uint64((1 << bits) - 1)).astype("<u4")
    b = np.unpackbits(low.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(b.ravel(), bitorder="little").tobytes()


def _windows(ws: list[bytes], n: int = C.SHINGLE) -> np.ndarray:
    """The hashes of :func:`common.shingles_of`, neither sorted nor distinct."""
    h = C.word_hashes(ws)
    return C.window_hashes(h, min(n, len(h))) + np.uint64(min(n, len(h))) if len(h) else h


def fingerprint(text: str | None, bins: int = BINS, bits: int = BITS) -> bytes:
    return packed(sketch(_windows(C.words(text)), bins), bits)


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity in 0..1; two texts without words are alike, one is unlike any other."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8), count=bins * bits).reshape(bins, bits)
    same, chance = float((~x.any(axis=1)).mean()), 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, sketched: bool = True) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row; the first three alone if not ``sketched``, as
    most of the time goes into the sketches.

    A row's next is the one before it by id, and the first row's that with the greatest. Null ids
    come last; a null text is empty; rows that share an id follow each other by the md5 of their text; a single row is its own next; an
    empty table gives no rows; other columns are ignored. Fingerprints are hexadecimal, and empty for a text without words.

    One shuffle: each text, compressed, goes to the partition of its range of ids, and the first row of every
    range also to the range before, whose last row it follows. Ranges hold about PART_TEXT_BYTES (more beyond 65,536 ranges), also if a third of all
    rows share an id or have none; rows of equal id and text travel as one with their number. A task walks its ranges in order and holds two texts at a time.
    """
    spark = docs.sparkSession
    C.text_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    md5 = F.unhex(F.md5(F.coalesce(F.col("t"), F.lit(""))))
    narrow = C.saved(base.select("k", (F.coalesce(F.octet_length("t"), F.lit(0)) + 32).cast("long").alias("w"), md5.alias("h")))
    plan = spark.sparkContext.broadcast(plan_ranges(narrow, PART_TEXT_BYTES))

    def ranks(keys: pa.Array, hashes: list[bytes]) -> np.ndarray:
        subs = np.frombuffer(b"".join(x[:2] for x in hashes), ">u2")
        return plan.value.ranks_down(keys, subs).astype(np.int32)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range the first row's place in the order: whether its id is null, the id's complement, the hash."""
        best: dict[int, tuple] = {}
        for b in batches:
            keys, hashes = b.column(b.schema.get_field_index("k")), b.column(b.schema.get_field_index("h")).to_pylist()
            for r, k, h in zip(ranks(keys, hashes).tolist(), keys.to_pylist(), hashes, strict=True):
                place = (k is None, 0 if k is None else ~k, h)
                if r not in best or place < best[r]:
                    best[r] = place
        cols = list(zip(*best.values(), strict=True)) or [()] * 3
        yield C.batch(r=pa.array(list(best), pa.int32()), none=pa.array(cols[0], pa.bool_()), inv=pa.array(cols[1], pa.int64()), h=pa.array(cols[2], pa.binary()))

    # one row for each range
    heads = sorted((x["r"], tuple(x["m"])) for x in narrow.select("k", "h").mapInArrow(tops, "r int, none boolean, inv long, h binary").groupBy("r").agg(F.min(F.struct("none", "inv", "h")).alias("m")).collect())
    before = {r: heads[i - 1][0] for i, (r, _) in enumerate(heads)}
    first = spark.sparkContext.broadcast({r: (None if m[0] else ~m[1], bytes(m[2]), before[r]) for r, m in heads})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, led = zstandard.ZstdCompressor(1), set()
        for b in batches:
            keys, texts = (b.column(b.schema.get_field_index(c)) for c in ("k", "t"))
            for a in range(0, len(keys), 500):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts.slice(a, 500).to_pylist()]
                hashes = [hashlib.md5(x).digest() for x in raws]
                held: dict[tuple, list] = {}
                for r, k, h, raw in zip(ranks(keys.slice(a, 500), hashes).tolist(), keys.slice(a, 500).to_pylist(), hashes, raws, strict=True):
                    if (k, h) in held:
                        held[k, h][3] += 1
                    else:
                        held[k, h] = [r, k, h, 1, raw]
                out: list[tuple] = []
                for r, k, h, n, raw in held.values():
                    z, f = squeeze.compress(raw), packed(sketch(_windows(raw.split()), bins), bits) if sketched else b""
                    out.append((r, 0, k, h, n, z, f))
                    if (k, h) == first.value[r][:2] and r not in led:  # a candidate for the row that follows the range before
                        led.add(r)
                        out.append((first.value[r][2], 1, k, h, 1, z, f))
                sent_kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
                yield C.batch(**{c: pa.array(v, kind) for c, v, kind in zip(("r", "guest", "k", "h", "n", "z", "f"), zip(*out, strict=True), sent_kinds, strict=True)})
        C.release()

    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string()}
    schema = "doc_id long, n_chars long, edited_sha256 string"
    if sketched:
        kinds |= {"fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
        schema += ", fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        held: tuple | None = None
        at, done = None, False
        out: list[tuple] = []

        def pair(row: tuple, following: tuple) -> tuple:
            k, t, f = row
            e = edited_text(t, following[1])
            digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
            if not sketched:
                return (k, len(t), digest)
            fe = fingerprint(e, bins, bits)
            return (k, len(t), digest, f.hex(), fe.hex(), likeness(f, fe, bins, bits), likeness(f, following[2], bins, bits))

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return C.batch(**{n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), cols, strict=True)})

        for rs, guests, ks, ns, zs, fs in C.rows_of(batches, "r", "guest", "k", "n", "z", "f"):
            for r, guest, k, n, z, f in zip(rs, guests, ks, ns, zs, fs, strict=True):
                if r != at:
                    at, held, done = r, None, False
                if done:
                    continue
                row = (k, expand.decompress(z).decode("utf-8", "surrogatepass"), f)
                if held is not None:
                    out.append(pair(held, row))
                held, done = row, bool(guest)
                if n > 1:  # all but the last of these are followed by their like
                    same = pair(row, row)
                    for a in range(0, n - 1, 500):
                        out += [same] * min(500, n - 1 - a)
                        if len(out) >= 500:
                            yield made()
                if len(out) >= 500:
                    yield made()
        if out:
            yield made()

    sent = base.mapInArrow(send, "r int, guest int, k long, h binary, n long, z binary, f binary")
    laid = sent.repartitionById(plan.value.size, F.col("r")).sortWithinPartitions("r", "guest", F.col("k").desc_nulls_last(), "h")
    return laid.mapInArrow(walk, schema)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.documents(spark, sf_dir))
