"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.sources.saved import saved


def ranked(df: DataFrame, group: str, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, a row's number from 1 in its group by ``order``, which ``bucket`` must rise with.

    Only bucket counts are summed along a group; rows are numbered within their bucket. So a group that holds most of the
    rows is spread over its buckets instead of meeting in one task.
    """
    with_bucket = df.withColumn("_bucket", bucket)
    counts = with_bucket.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_bucket")
    offsets = counts.withColumn("_before", F.sum("_c").over(before) - F.col("_c")).drop("_c").withColumnsRenamed({group: "_group", "_bucket": "_b"})
    joined = with_bucket.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    inner = Window.partitionBy(group, "_bucket").orderBy(*order)
    return joined.withColumn(out, (F.row_number().over(inner) + F.col("_before")).cast("long")).drop("_bucket", "_before", "_group", "_b")


#: Bits that ``monotonically_increasing_id`` gives to a row's place in its partition.
_PLACE = 33


def numbered(df: DataFrame, order: list[str], group: list[str] | None = None, out: str = "_n", total: str = "_of") -> DataFrame:
    """Adds ``out``, a row's number from 1 by ``order`` within its ``group`` (default: all rows), and ``total``, the group's rows.

    Rows are sorted into ranges once and saved; ties fall in any order, but the same whenever the result is read. A group or a value that most rows
    share is spread over ranges. Only the ranges' counts are summed along a group, a row for each group and range; a null is a group of its own.
    """
    group = group or []
    keys = [*group, *order, "__tie"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = saved(dealt.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", _PLACE), F.col("__id").bitwiseAND((1 << _PLACE) - 1)
    sums = dealt.groupBy(*group, part.alias("__part")).agg(F.count(F.lit(1)).alias("__m"), F.min(place).alias("__first"))
    along = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    upto = F.sum("__m").over(along.orderBy("__part"))
    offsets = sums.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)], "__part", (upto - F.col("__m") - F.col("__first") + 1).alias("__shift"), F.sum("__m").over(along).alias(total))
    if not group:
        offsets = F.broadcast(offsets)  # a row for each range
    same = part == F.col("__part")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    return dealt.join(offsets, same).withColumn(out, place + F.col("__shift")).drop("__id", "__part", "__shift", *[f"__g{k}" for k in range(len(group))])
