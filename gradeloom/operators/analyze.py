"""Analyses of graded rows, as long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X

from .cursor import occurrence_join
from .ranks import numbered, ranked

OK = "_ok"


def flagged(df: DataFrame) -> DataFrame:
    kind = df.schema["is_correct"].dataType.simpleString()
    return df.withColumns({OK: X.is_correct(F.col("is_correct"), kind), "_bad": X.is_incorrect(F.col("is_correct"), kind)})


def counter(df: DataFrame, column: str, order: str = "_pos") -> DataFrame:
    """Counts of a column's labels; rank by count, ties by first occurrence."""
    sums = df.groupBy(X.label(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_pos"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_pos")).cast("long"))


#: Values of a group up to which one task finds its quartiles.
WHOLE = 1_000_000


def quantiles(df: DataFrame, column: str, by: list[str] | None = None, whole: int = WHOLE) -> DataFrame:
    """Exact quartiles by linear interpolation, and mean, of the values that are numbers (NaN is the greatest).

    A task finds the quartiles of groups of up to ``whole`` values. Beyond that values are numbered along their groups by a distributed sort, and only
    those next to a quartile are looked at, so that no task holds a group; the results are the same.
    """
    by = by or []
    rows = df.select(*by, X.numeric_value(F.col(column)).alias("__v"))
    sums = [F.count("__v").alias("n"), F.avg("__v").alias("mean")]
    if (rows.groupBy(*by).agg(sums[0]).agg(F.max("n")).first()[0] or 0) <= whole:
        p = F.percentile("__v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return rows.groupBy(*by).agg(sums[0], p[0].alias("q1"), p[1].alias("q2"), p[2].alias("q3"), sums[1])
    placed = numbered(rows.where("__v is not null"), ["__v"], by, "__n", "__of")
    aggs = []
    for k, share in enumerate((0.25, 0.5, 0.75), 1):
        at, place = (F.col("__of") - 1) * share, F.col("__n") - 1
        aggs += [F.max(F.when(place == F.floor(at), F.col("__v"))).alias(f"low{k}"), F.max(F.when(place == F.ceil(at), F.col("__v"))).alias(f"high{k}"), F.max(at - F.floor(at)).alias(f"part{k}")]
    found = placed.groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(by)]).agg(*aggs)
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    quartiles = []
    for k in (1, 2, 3):
        low, high, part = F.col(f"low{k}"), F.col(f"high{k}"), F.col(f"part{k}")
        quartiles.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(f"q{k}"))
    return rows.groupBy(*by).agg(*sums).join(found, same, "left").select(*by, "n", *quartiles, "mean")


def breakdown(df: DataFrame) -> DataFrame:
    """Incorrect rows by finish reason, reason, box source and think type, with the listed reasons first."""
    four = ("finish_reason", "reason", "last_box_source", "think_type")
    sums = flagged(df).where("_bad").groupBy(*[X.label(F.col(c)).alias(c) for c in four]).agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first_pos"))
    return sums.withColumn("finish_rank", X.finish_rank(F.col("finish_reason"), "length", "stop").cast("int"))


def other_reasons(df: DataFrame) -> DataFrame:
    """Incorrect rows that are neither unmatched nor without a box, by finish reason and reason: counts of think types and of box sources, in one pass."""
    rows = flagged(df).where("_bad").select(*[X.label(F.col(c)).alias(c) for c in ("finish_reason", "reason", "think_type", "last_box_source")], "_pos").where(~F.col("reason").isin("no_match", "can_not_extract"))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("think_type", "last_box_source")]))
    return rows.select("finish_reason", "reason", "_pos", kinds.alias("x")).groupBy("finish_reason", "reason", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first_pos"))


def unboxed_indexes(df: DataFrame) -> DataFrame:
    """Incorrect rows without a box source, to be listed in order."""
    source = X.label(F.col("last_box_source"))
    return flagged(df).where(F.col("_bad") & source.isin("none", X.MISSING)).select("_pos", "index", source.alias("last_box_source"))


def with_ratio(df: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds train_token (null: no such row, NaN: no value), ratio and group of the rows."""
    out = df.withColumn("_key", X.key_text(F.col("index"))).join(tokens.select(F.col("index").alias("_key"), "train_token"), "_key", "left").drop("_key")
    return out.withColumn("ratio", X.ratio(F.col("output_token_length"), F.col("train_token"))).withColumn("ratio_group", X.ratio_group(F.col("ratio")))


def ratio_histogram(df: DataFrame) -> DataFrame:
    """Rows in each of the seven buckets, empty ones too; rows without a ratio are in none."""
    spark = df.sparkSession
    dim = spark.createDataFrame(list(enumerate(X.RATIO_LABELS, 1)), "ratio_group int, bucket string")
    sums = df.where("ratio_group is not null").groupBy("ratio_group").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(sums, "ratio_group", "left").select("ratio_group", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def positives(predictions: DataFrame, generations: DataFrame, tokens: DataFrame) -> DataFrame:
    """Correct rows with their generation's tokens (else the prediction's) and ratio; rows say what they miss."""
    gen = generations.select(X.key_text(F.col("index")).alias("_key"), F.col("output_token_length").alias("_gen"), F.lit(True).alias("has_generation"))
    ok = flagged(predictions).where(OK).withColumn("_key", X.key_text(F.col("index"))).join(gen, "_key", "left")
    ok = ok.withColumn("output_token_length", F.coalesce(X.numeric_value(F.col("_gen")), X.numeric_value(F.col("output_token_length"))))
    return with_ratio(ok.withColumn("has_generation", F.coalesce("has_generation", F.lit(False))), tokens).drop("_gen", "_key")


def _accuracy_aggs() -> list[Column]:
    t, ok = X.numeric_value(F.col("output_token_length")), F.col(OK)
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"),
        F.coalesce(100.0 * F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("accuracy"),
        F.avg(t).alias("avg_tokens"), F.avg(F.when(ok, t)).alias("avg_tokens_correct"), F.avg(F.when(~ok, t)).alias("avg_tokens_incorrect"),
    ]


def benchmark(df: DataFrame) -> DataFrame:
    """Accuracy by dataset and for all (``<all>``), in one pass; whatever isn't correct is incorrect here."""
    sums = flagged(df).withColumn("dataset", X.to_text(F.col("dataset"), "unknown")).rollup("dataset").agg(*_accuracy_aggs(), F.grouping("dataset").alias("_g"))
    return sums.withColumn("dataset", F.when(F.col("_g") == 1, F.lit("<all>")).otherwise(F.col("dataset"))).drop("_g")


def finish_matrix(df: DataFrame) -> DataFrame:
    """Correctness by dataset and finish reason; stop and length first, others by name."""
    t = X.numeric_value(F.col("output_token_length"))
    sums = flagged(df).groupBy(X.to_text(F.col("dataset"), "unknown").alias("dataset"), X.label(F.col("finish_reason")).alias("finish_reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(OK).alias("correct"), F.count_if(~F.col(OK)).alias("incorrect"), F.avg(t).alias("avg_tokens"))
    return sums.withColumn("finish_rank", X.finish_rank(F.col("finish_reason"), "stop", "length").cast("int"))


def case_numbers(df: DataFrame) -> DataFrame:
    """Incorrect rows numbered within their dataset."""
    rows = flagged(df).where(~F.col(OK))
    at = rows.agg(F.min("_pos").alias("a"), F.max("_pos").alias("b"), F.count(F.lit(1)).alias("n")).first()
    low, width = (at["a"] or 0), max(1, ((at["b"] or 0) - (at["a"] or 0)) // (1 + math.isqrt(at["n"])))
    return ranked(rows, "dataset", F.floor((F.col("_pos") - low) / width), [F.col("_pos")], "case_number")


def enriched(predictions: DataFrame, generations: DataFrame) -> DataFrame:
    """Predictions with dataset, question and output filled from their generation (an empty text is a value), predict and ``_is_correct``."""
    links = occurrence_join(predictions, generations)
    g = generations.select(F.col("_pos").alias("g_pos"), *[F.col(c).alias(f"_g_{c}") for c in ("dataset", "question", "model_output")])
    out = predictions.join(links.withColumnRenamed("p_pos", "_pos"), "_pos", "left").join(g, "g_pos", "left")
    for c, default in (("dataset", "unknown"), ("question", ""), ("model_output", "")):
        own = F.col(c).cast("string") if c in predictions.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(own, F.col(f"_g_{c}").cast("string"), F.lit(default)))
    out = out.withColumn("predict", X.to_text(F.col("extracted_answer")) if "extracted_answer" in predictions.columns else F.lit(""))
    if "is_correct" in predictions.columns:
        out = out.withColumn("_is_correct", X.is_correct(F.col("is_correct"), predictions.schema["is_correct"].dataType.simpleString()))
    return out.drop("g_pos", "_g_dataset", "_g_question", "_g_model_output")
