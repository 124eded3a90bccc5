"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of segments (a document's ids, cut at about the source's share of a window, so that each window can hold every source). Each
round credits a source with its share of a window, and the source sends segments as long as its credit covers them; what it can't
send yet stays as its deficit for the next round. For queues that are not empty this has a closed form: with ``e`` the ids
of the queue up to and with a segment, the segment leaves in round ceil(e / quantum), and the deficit
after round r is r * quantum less the ids sent. Rounds are therefore assigned to all segments at once from
prefix sums, and deficits carry over windows and partitions by construction. The segments, by round, then source,
then queue order, form one stream that is cut every ``window`` ids, so that only the last window is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .encoding import CACHED, encoder, forget
from .ranges import running_sum

WINDOW = 2048
#: Ids of a segment at most, and at least (of a source whose share of a window is smaller).
SEGMENT, LEAST_SEGMENT = 512, 64


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, source_col: str, cached: int = CACHED, keep: bool = True) -> DataFrame:
    """_id, _src, _th, n and the compressed ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(tokenizer, cached), zstandard.ZstdCompressor(1)
        tail = np.array([] if end_id is None else [end_id], enc.dtype).tobytes()
        for keys, sources, hashes, texts in C.rows_of(batches, "_id", "_src", "_th", "t"):
            for a in range(0, len(keys), 500):
                got = [ids.tobytes() + tail for ids in enc.encode(texts[a : a + 500])]
                yield C.batch(
                    _id=pa.array(keys[a : a + 500], pa.int64()), _src=pa.array(sources[a : a + 500], pa.string()), _th=pa.array(hashes[a : a + 500], pa.int64()),
                    n=pa.array([len(b) // enc.dtype.itemsize for b in got], pa.int64()), z=pa.array([squeeze.compress(b) for b in got], pa.binary()),
                )
        if not keep:
            del enc
            forget(tokenizer)
            C.release()

    cols = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_src"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("t"))
    return cols.mapInArrow(run, "_id long, _src string, _th long, n long, z binary")


def _quanta(stats: DataFrame, window: int, shares: dict) -> DataFrame:
    """``stats`` with _q, the ids that a source is credited with in a round."""
    spark = stats.sparkSession
    named = C.local_table(spark, [(s, float(x)) for s, x in shares.items()], name=pa.string(), share=pa.float64())
    joined = stats.join(named, F.col("s").eqNullSafe(F.col("name")), "left")
    at = joined.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("t")))).first()
    left, free = max(0.0, 1.0 - (at[0] or 0.0)), max(1, at[1] or 0)
    return joined.withColumn("_q", F.greatest(F.coalesce("share", F.lit(left) * F.col("t") / F.lit(free)) * window, F.lit(1e-6)))


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 1, window: int = WINDOW, shares: dict | None = None, segment: int = SEGMENT, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cached: int = CACHED, keep: bool = True) -> DataFrame:
    """Packs every row into windows of ``window`` ids; returns a row for each piece.

    Columns: doc_id, start (ids of the row before the piece), length, ids_crc32, doc_tokens, sequence_id, offset,
    source. ``shares`` are target proportions by source (default: by the ids that a source has, so that
    all queues end together); a source without one shares what is left by its ids; one with a share of 0 comes after all that have one. A null text is empty
    and has its end id alone, a null source is a queue of its own, ids may be null, rows that repeat are packed each, an
    empty table gives no rows, other columns are ignored. Windows are numbered from 0 and full but for the last.
    ``cached`` bounds what a worker remembers of the tokenizer's results, and without ``keep`` it forgets them at the end of each task; both trade memory for time and change no row.

    Ids are made once and stored, compressed; orders and cuts are found on narrow rows; the cuts are then joined to the ids.
    Sums run over buckets of a source (square roots of the counts) and over ranges of the stream, never over a whole source or stream in one task. Sources are a table, of any number.
    """
    spark = docs.sparkSession
    C.text_batches(spark)
    coded = C.saved(encoded(docs, tokenizer, end_id, id_col, text_col, source_col, cached, keep).withColumns({"_row": F.monotonically_increasing_id(), "_queue": F.xxhash64("_src")}), "none")
    stats = C.saved(coded.groupBy("_queue").agg(F.first("_src").alias("s"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")))
    queues = _quanta(stats, window, shares or {})
    whole = F.ceil(F.col("_q") / F.ceil(F.col("_q") / segment))  # a quantum over ``segment`` is cut evenly
    queues = C.small(C.saved(queues.select("_queue", "_q", F.ceil(F.sqrt("c")).cast("long").alias("_nb"), F.least(F.lit(segment), F.greatest(F.lit(min(LEAST_SEGMENT, segment)), whole)).cast("long").alias("_seg"))))

    rows = coded.select("_row", "_id", "_th", "_queue", "n").join(queues, "_queue")
    rows = rows.withColumn("_h", C.hash_key(F.col("_id"), F.col("_th"), seed=seed)).withColumn("_b", C.bucket_of(F.col("_h"), F.col("_nb")))
    rows = C.saved(C.prefix_sum(rows, ["_queue"], "_b", ["_h", "_row"], "n", "_at").where("n > 0").select("_row", "_queue", "_q", "_seg", "_at", "n"))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div _seg")), lambda k: F.struct((k * F.col("_seg")).alias("from"), F.least(F.col("_seg"), F.col("n") - k * F.col("_seg")).alias("len")))
    segs = rows.select("_row", "_queue", "_q", "_seg", "_at", F.explode(pieces).alias("p")).select("_row", "_queue", "_seg", F.col("p.from").alias("_from"), F.col("p.len").alias("_len"), (F.col("_at") + F.col("p.from")).alias("_pos"), F.ceil((F.col("_at") + F.col("p.from") + F.col("p.len")) / F.col("_q")).cast("long").alias("_round"))
    segs = running_sum(segs, [F.col("_round"), F.col("_queue"), F.col("_pos"), F.col("_row")], "_len", "_to", keep=["_row", "_seg", "_from"])
    cuts = segs.groupBy("_row").agg(F.first("_seg").alias("seg"), F.transform(F.array_sort(F.collect_list(F.struct("_from", "_to"))), lambda x: x["_to"]).alias("segs"))  # a row's own segments alone
    cuts = C.saved(cuts)

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            if not b.num_rows:
                continue
            keys, sources, ns, zs, seg, segs = (b.column(b.schema.get_field_index(c)) for c in ("_id", "_src", "n", "z", "seg", "segs"))
            n, counts = ns.to_numpy(), segs.value_lengths().to_numpy()
            to = segs.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), counts)
            size = seg.to_numpy()[row]
            at = (np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
            length = np.minimum(size, n[row] - at)
            # segments of a row that follow each other in the stream are one run; a run is cut at the windows' ends
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (to[1:] != to[:-1] + length[:-1])))
            first = np.flatnonzero(new)
            length, row, at, to = np.add.reduceat(length, first), row[first], at[first], to[first]
            times = (to + length - 1) // window - to // window + 1
            turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at, to, length = (np.repeat(x, times) for x in (row, at, to, length))
            begin, end = np.maximum(to, (to // window + turn) * window), np.minimum(to + length, (to // window + turn + 1) * window)
            start, length = at + begin - to, end - begin
            crcs = np.empty(len(start), np.int64)
            held, raw = -1, b""
            for i, (r, a, c) in enumerate(zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True)):
                if r != held:
                    ids = expand.decompress(zs[r].as_py())
                    held, raw = r, memoryview(np.frombuffer(ids, f"<u{len(ids) // n[r]}").astype("<u4").tobytes())
                crcs[i] = zlib.crc32(raw[a:c])
            where = pa.array(row)
            yield C.batch(**dict(zip(names, (keys.take(where), pa.array(start), pa.array(length), pa.array(crcs), ns.take(where), pa.array(begin // window), pa.array(begin % window)), strict=True)), source=sources.take(where))
        C.release()

    ready = coded.select("_row", "_id", "_src", "n", "z").join(C.small(cuts), "_row")
    return ready.drop("_row").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
