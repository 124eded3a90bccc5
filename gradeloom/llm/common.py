"""Shared helpers of the corpus operators: words, hashes, shared tables, prefix sums.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D. ``bytes.split()`` without an
argument splits on exactly these, and UTF-8 continuation bytes never fall in that set, so splitting
the encoded text equals splitting the code points.
"""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Size of the files of a table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 24 << 20
SHINGLE = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/gradeloom-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: the lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that :func:`saved` returned."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table with a broadcast hint if its files are within ``limit``, else unchanged."""
    return F.broadcast(df) if file_bytes(df) <= limit else df


def local_table(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A few rows of the driver as a table. They go over as Arrow: rows of Python would start workers of another kind on every executor,
    which stay there beside the operators' own."""
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types)))


def release_executors(spark: SparkSession) -> None:
    """Has the executors collect their heaps, which gives what stands free back to the system. Between two stages nearly all of a heap is garbage,
    and it would stay beside the Python workers of the next stage. A task for each core, so that idle executors get some each."""
    sc = spark.sparkContext
    tasks = 1 if sc.master.split("[")[0] == "local" else sc.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def text_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Has Arrow batches of ``rows`` rows, where the session has Spark's default of 10,000: whole texts are long, and the JVM and the
    worker of every running task each hold a batch. A session that sets another size keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int, mul: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of ``n`` items, by doubling: O(len * log n)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, have, span, power, base = None, 0, 1, mul, mix(h + np.uint64(mul & 0xFFFF))
    left = n
    while True:
        if left & 1:
            out = base.copy() if out is None else out[: len(h) - have - span + 1] + np.uint64(pow(mul, have, 1 << 64)) * base[have:][: len(h) - have - span + 1]
            have += span
        left >>= 1
        if not left:
            return mix(out[: len(h) - n + 1])
        base = base[: len(base) - span] + np.uint64(power) * base[span:]
        power = pow(power, 2, 1 << 64)
        span *= 2


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a shorter text is one run, no words give none."""
    return shingles_of(words(text), n)


def shingles_of(ws: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """As :func:`shingles`, of a text's words."""
    h = word_hashes(ws)
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(n, len(h))) + np.uint64(min(n, len(h))))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def release() -> None:
    """Turns the collector on and gives freed memory back to the system. A worker that waits for its next task would keep it, beside the JVM."""
    gc.enable()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as lists; at the end, memory of earlier batches is released."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
    b = None
    release()


def groups(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[tuple]:
    """Runs of rows with the same key in sorted batches: the key, and a list for each other column."""
    at, held = None, [[] for _ in names]
    for key_col, *cols in rows_of(batches, key, *names):
        edges = [0, *(i for i in range(1, len(key_col)) if key_col[i] != key_col[i - 1]), len(key_col)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held[0] and key_col[a] != at:
                yield at, *held
                held = [[] for _ in names]
            at = key_col[a]
            for h, c in zip(held, cols, strict=True):
                h.extend(c[a:b])
    if held[0]:
        yield at, *held


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def hash_key(*cols: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def bucket_of(h: Column, n: Column) -> Column:
    """Bucket 0 .. n-1 that rises with the signed hash ``h``."""
    return F.least((F.shiftright(h, 33) + F.lit(1 << 30)) * n / F.lit(1 << 31), n - 1).cast("long")


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` of all rows before this one in its group, the order being
    ``bucket`` then ``order``. Only bucket sums are summed along a whole group; rows are summed within
    their bucket, so that a group of any size is spread over its buckets."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = sums.withColumn("_o", F.sum("_s").over(before.orderBy(bucket)) - F.col("_s")).drop("_s")
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(offsets, [*group, bucket]).withColumn(out, F.sum(value).over(inner) - F.col(value) + F.col("_o")).drop("_o")


def root_buckets(n: int, least: int = 1) -> int:
    return max(least, math.isqrt(max(0, n - 1)) + 1)
