"""Suspected false negatives and the verdicts on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.sources.readers import require_keys, require_unique

from .analyze import flagged


def suspects(predictions: DataFrame, generations: DataFrame, checked: bool = True) -> DataFrame:
    """Incorrect rows with what a reviewer reads; each must have its generation."""
    bad = flagged(predictions).where("_bad")
    if checked:
        require_unique(generations, "index")
        require_keys(bad, generations)
    g = generations.select(X.key_text(F.col("index")).alias("_key"), X.to_text(F.col("question")).alias("question"), F.col("model_output").alias("_output"), F.col("label").alias("_label"))
    out = bad.drop("question", "model_output").withColumn("_key", X.key_text(F.col("index"))).join(g, "_key")
    text = X.review_slice(F.col("reason"), F.col("last_box_source"), F.col("_output"))
    label = F.col("label") if "label" in predictions.columns else F.col("_label")
    return out.select(*[c for c in ("_pos",) if c in out.columns], "index", "question", label.alias("label"), text.alias("model_output"))


def apply_verdicts(predictions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Rows whose index (as text) is confirmed become correct by judgement."""
    marked = predictions.withColumn("_key", X.key_text(F.col("index"))).join(confirmed.select(X.key_text(F.col("index")).alias("_key"), F.lit(True).alias("_hit")).distinct(), "_key", "left")
    hit = F.coalesce("_hit", F.lit(False))
    kind = predictions.schema["is_correct"].dataType
    return marked.withColumns({"is_correct": F.when(hit, F.lit(1).cast(kind)).otherwise(F.col("is_correct")), "reason": F.when(hit, F.lit("llm_judge")).otherwise(F.col("reason"))}).select(predictions.columns)


def without_confirmed(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    return rows.withColumn("_key", X.key_text(F.col("index"))).join(confirmed.select(X.key_text(F.col("index")).alias("_key")), "_key", "left_anti").drop("_key")


def verdict_counts(predictions: DataFrame, confirmed: DataFrame, suspected: DataFrame | None = None) -> DataFrame:
    """Rows, rows updated, confirmed keys without a row, and (with ``suspected``) suspects removed."""
    p = predictions.select(X.key_text(F.col("index")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    c = confirmed.select(X.key_text(F.col("index")).alias("k")).distinct().withColumn("hit", F.lit(True))
    both = p.join(c, "k", "full")
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("updated"), F.count_if(F.col("n").isNull()).alias("missing")]
    if suspected is not None:
        both = both.join(suspected.select(X.key_text(F.col("index")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("s")), "k", "full")
        sums.append(F.coalesce(F.sum(F.when(F.col("hit"), F.col("s"))), F.lit(0)).alias("removed"))
        sums[2] = F.count_if(F.col("hit") & F.col("n").isNull()).alias("missing")
    return both.agg(*sums)
