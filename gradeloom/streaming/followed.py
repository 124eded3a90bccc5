"""A result log that is followed: appended by micro-batches, read back in order, with a table of the latest successes and sums of every batch.

Under the log's folder ``batch=N`` holds the rows of micro-batch N, ``_stats/batch=N`` its sums, ``_latest/data/batch=N/bucket=K`` the latest successes of the keys of a
bucket that N changed, and ``_latest/manifest/batch=N`` which batch holds each bucket after N. All that batch N writes has its number in its name and is made from what came before
N, so that a batch that runs twice leaves the same. A reader takes the last manifest that is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.sources.readers import last_per_key

from . import checkpoints

BUCKETS = 64
SUMS = ("lines", "malformed", "ok", "errors", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")


def follow(spark: SparkSession, directory: str, log: str, checkpoint: str, files_per_trigger: int = 4, buckets: int = BUCKETS):
    """A query that appends the results landing in ``directory``. Each micro-batch takes a bounded number of files; a restart goes on where the checkpoint ends.

    ``_pos`` orders the log's rows: batch, the file's time and name, place in the file. Blank lines are skipped; lines that aren't JSON objects are counted and left out.
    """
    place = [F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(directory).select("value", *place)

    def append(batch: DataFrame, number: int) -> None:
        seen = Observation()
        pos = F.struct(F.lit(number).cast("long").alias("batch"), "time", "file", "block", F.col("_line").alias("line"))
        rows = batch.withColumn("_line", F.monotonically_increasing_id()).where(X.clean_text(F.col("value")) != "").select(pos.alias("_pos"), F.try_parse_json("value").alias("_v"))
        good = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(~good).alias("malformed")).where(good)
        checkpoints.parse_results(rows, "_pos").write.mode("overwrite").parquet(f"{log}/batch={number}")
        fresh = batch.sparkSession.read.parquet(f"{log}/batch={number}")
        _sums(fresh, seen.get).write.mode("overwrite").parquet(f"{log}/_stats/batch={number}")
        _compact(fresh, f"{log}/_latest", number, buckets)

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sums(fresh: DataFrame, seen: dict[str, int]) -> DataFrame:
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS[4:]]
    counted = fresh.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("errors"), *tokens)
    return counted.select(*[F.lit(seen[c]).cast("long").alias(c) for c in SUMS[:2]], *SUMS[2:])


def totals(spark: SparkSession, log: str) -> DataFrame:
    """Sums over the batches of a followed log."""
    rows = spark.read.parquet(f"{log}/_stats")
    return rows.agg(F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in SUMS])


def _batches(spark: SparkSession, folder: str, whole: bool = False) -> list[int]:
    """Numbers of the batch folders, ascending; with ``whole`` only of those that were written to the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where(folder))]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and (not whole or fs.exists(where(f"{folder}/{n}/_SUCCESS"))))


def _held(spark: SparkSession, top: str, before: int | None = None) -> dict[int, int]:
    """The batch that holds each bucket, by the last manifest (before a batch): a row for each bucket."""
    found = [n for n in _batches(spark, f"{top}/manifest", whole=True) if before is None or n < before]
    return {r["bucket"]: r["held"] for r in spark.read.parquet(f"{top}/manifest/batch={found[-1]}").collect()} if found else {}


def _read(spark: SparkSession, top: str, held: dict[int, int]) -> DataFrame | None:
    paths = [f"{top}/data/batch={n}/bucket={k}" for k, n in sorted(held.items())]
    return spark.read.parquet(*paths) if paths else None


def _compact(fresh: DataFrame, top: str, number: int, buckets: int) -> None:
    """Merges a batch's successes into the latest ones; only the buckets of its keys are read and written."""
    spark = fresh.sparkSession
    held = _held(spark, top, number)
    bucket = F.pmod(F.xxhash64("index"), F.lit(buckets)).cast("int")
    good = fresh.where(checkpoints.succeeded())
    changed = [r[0] for r in good.select(bucket).distinct().collect()]  # a row for each bucket
    if changed:
        old = _read(spark, top, {k: held[k] for k in changed if k in held})
        rows = good if old is None else old.unionByName(good)
        last_per_key(rows).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{top}/data/batch={number}")
        held |= dict.fromkeys(changed, number)
    spark.createDataFrame(sorted(held.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{top}/manifest/batch={number}")
    _clear(spark, top, number, held)


def _clear(spark: SparkSession, top: str, number: int, held: dict[int, int]) -> None:
    """Removes what neither the last manifest nor the one before names, so that a reader of the one before can end."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(top).getFileSystem(spark._jsc.hadoopConfiguration())
    needed = {*held.values(), *_held(spark, top, number).values(), number}
    for n in _batches(spark, f"{top}/data"):
        if n not in needed and n < number:
            fs.delete(where(f"{top}/data/batch={n}"), True)
    for n in _batches(spark, f"{top}/manifest")[:-2]:
        fs.delete(where(f"{top}/manifest/batch={n}"), True)


def latest(spark: SparkSession, log: str) -> DataFrame:
    """The latest success of each index of a followed log, from its table; without any success yet, from its rows."""
    top = f"{log}/_latest"
    found = _read(spark, top, _held(spark, top))
    return checkpoints.latest(spark.read.parquet(log).drop("batch")) if found is None else found
