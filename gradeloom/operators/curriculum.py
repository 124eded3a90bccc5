"""Selection of a hard set of given size, the rest being easy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X

from .analyze import OK, flagged, with_ratio
from .ranks import ranked as number_rows


def annotated(predictions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Predictions with ratio_group of the correct ones (null without a ratio)."""
    out = with_ratio(flagged(predictions), tokens)
    return out.withColumn("ratio_group", F.when(F.col(OK), F.col("ratio_group")))


def ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Seeded rank of each row in its group, groups 1 and 2 being one, and the groups' sizes."""
    stage = F.when(~F.col(OK), F.lit("incorrect")).when(F.col("ratio_group").isNull(), F.lit("missing")).when(F.col("ratio_group") <= 2, F.lit("group_1_2")).otherwise(F.concat(F.lit("group_"), F.col("ratio_group").cast("string")))
    out = rows.withColumn("pool", stage)
    # only pools that are sampled are ranked; the others pass by
    sampled = F.col("pool").isin("group_1_2", "group_3", "group_4")
    h = X.seeded(seed, F.col("index"))
    drawn = number_rows(out.where(sampled), "pool", F.substring(h, 1, 4), [h, F.col("index").cast("string")], "rank")
    return drawn.unionByName(out.where(~sampled).withColumn("rank", F.lit(0).cast("long")))


def pool_sizes(rows: DataFrame) -> dict[str, int]:
    """Rows of each pool of ranked rows."""
    return {r["pool"]: r["count"] for r in rows.groupBy("pool").count().collect()}  # at most nine


def base_size(n: dict[str, int]) -> int:
    """Rows that are hard before the fill."""
    return sum(n.get(p, 0) for p in ("incorrect", "group_5", "group_6", "group_7")) + n.get("group_3", 0) // 2 + n.get("group_4", 0) // 2


def split(predictions: DataFrame, tokens: DataFrame, target: int, seed: int, checked: bool = True) -> DataFrame:
    """Adds ``hard``: all incorrect rows, groups 7 to 5, the floor half of 4 and of 3, then groups 1 and 2 up to the target.

    Too large a base or too small a fill is an error. Samples are the least seeded hashes.
    """
    rows = ranked(annotated(predictions, tokens), seed)
    return chosen(rows, pool_sizes(rows), target, checked)


def chosen(rows: DataFrame, n: dict[str, int], target: int, checked: bool = True) -> DataFrame:
    """As :func:`split`, of ranked rows whose pools have ``n`` rows."""
    half = {g: n.get(g, 0) // 2 for g in ("group_3", "group_4")}
    base = base_size(n)
    fill = target - base
    if checked and fill < 0:
        raise ValueError(f"the base selection has {base} rows, over the target of {target}")
    if checked and fill > n.get("group_1_2", 0):
        raise ValueError(f"cannot fill {fill} rows from {n.get('group_1_2', 0)}")
    pool, rank = F.col("pool"), F.col("rank")
    hard = pool.isin("incorrect", "group_5", "group_6", "group_7") | ((pool == "group_4") & (rank <= half["group_4"])) | ((pool == "group_3") & (rank <= half["group_3"])) | ((pool == "group_1_2") & (rank <= max(0, fill)))
    return rows.withColumn("hard", hard)


def ledger(rows: DataFrame) -> DataFrame:
    """Selected and left rows of each pool."""
    return rows.groupBy("pool").agg(F.count_if("hard").alias("hard"), F.count_if(~F.col("hard")).alias("easy"))


def self_check(rows: DataFrame, target: int) -> DataFrame:
    """Sizes of hard, easy, overlap and union by key, and whether the hard set has its size."""
    keys = rows.groupBy(X.key_text(F.col("index")).alias("k")).agg(F.bool_or("hard").alias("h"), F.bool_or(~F.col("hard")).alias("e"))
    out = keys.agg(F.count_if("h").alias("hard"), F.count_if("e").alias("easy"), F.count_if(F.col("h") & F.col("e")).alias("overlap"), F.count(F.lit(1)).alias("union"))
    return out.withColumn("target_met", F.col("hard") == target)
