"""Curation: thresholds, exact samples, alignment, key checks, filters and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.sources.readers import require_columns, require_keys, require_unique


def threshold(df: DataFrame, column: str | None, most: float | None) -> DataFrame:
    """Rows up to a bound; both arguments or neither. Null and NaN go."""
    if (column is None) != (most is None):
        raise ValueError("give both a column and its bound, or neither")
    if column is None:
        return df
    return require_columns(df, column).where(F.col(column) <= F.lit(most))


def sample(df: DataFrame, n: int, seed: int, key: str = "index", checked: bool = True) -> DataFrame:
    """Exactly n rows in seeded order: a top-n of hashes, so no full sort and no dependence on partitions."""
    if checked and df.count() < n:
        raise ValueError(f"cannot sample {n} of {df.count()} rows")
    return df.withColumn("_order", X.seeded(seed, F.col(key))).orderBy("_order", F.col(key).cast("string")).limit(n)


def limited(df: DataFrame, n: int | None, order: str = "_pos") -> DataFrame:
    if n is not None and n < 0:
        raise ValueError("a limit must not be negative")
    return df if n is None else df.orderBy(order).limit(n)


def align(df: DataFrame, hints: DataFrame, key: str = "index", checked: bool = True) -> DataFrame:
    """Hints of the rows of ``df``, one each; a missing one is an error."""
    if checked:
        require_unique(hints, key)
        require_keys(df, hints, key)
    return hints.join(df.select(key, *[c for c in ("_pos", "_order") if c in df.columns]), key)


def without_keys(df: DataFrame, keys: DataFrame, key: str = "index") -> DataFrame:
    """Anti-join by text; the optimizer broadcasts a key list that it knows is small."""
    return df.withColumn("_key", X.key_text(F.col(key))).join(keys.select(X.key_text(F.col("index")).alias("_key")), "_key", "left_anti").drop("_key")


def single_box(df: DataFrame, column: str = "solution") -> DataFrame:
    return df.where(X.boxed_count(F.col(column)) <= 1)


def funnel(df: DataFrame, invalid: DataFrame, key: str = "index", column: str = "solution", hints: DataFrame | None = None) -> DataFrame:
    """Counts before and after the filters, in one pass: rows, keys in the invalid file, rows of these, rows left, of these with several boxes, and without;
    with ``hints``, the hints of the rows left."""
    flags = df.select(X.key_text(F.col(key)).alias("_key"), (X.boxed_count(F.col(column)) > 1).alias("multi"), F.lit(1).alias("row"))
    bad = invalid.select(X.key_text(F.col("index")).alias("_key"), F.lit(True).alias("bad")).where("_key is not null").distinct()
    joined = flags.join(bad, "_key", "full").withColumns({"listed": F.coalesce("bad", F.lit(False)), "bad": F.coalesce("bad", F.lit(False))}).withColumn("row", F.col("row").isNotNull())
    good = F.col("row") & ~F.col("bad")
    counts = [
        F.count_if("row").alias("original"), F.count_distinct(F.when(F.col("listed"), F.col("_key"))).alias("invalid_in_file"), F.count_if(F.col("row") & F.col("bad")).alias("invalid_matched"), F.count_if(good).alias("after_invalid"),
        F.count_if(good & F.col("multi")).alias("multi_box"), F.count_if(good & ~F.col("multi")).alias("after_multi_box"),
    ]
    if hints is not None:
        have = hints.select(X.key_text(F.col("index")).alias("_key"), F.lit(1).alias("hint")).where("_key is not null").distinct()
        joined = joined.join(have, "_key", "left")
        counts.append(F.count_if(good & ~F.col("multi") & F.col("hint").isNotNull()).alias("hints"))
    return joined.agg(*counts)


def key_profile(df: DataFrame, key: str = "index") -> DataFrame:
    k = F.col(key)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(k.isNull()).alias("null_count"), F.count_distinct(k).alias("unique_count")).withColumn("duplicate_count", F.col("rows") - F.col("null_count") - F.col("unique_count"))


def duplicate_examples(df: DataFrame, key: str = "index", most: int = 10, order: str = "_pos") -> DataFrame:
    """The first repeated keys by where they first repeat: their rows, first and second position. Both are found by partial minima, so that a key of any number of rows is combined map-side."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(order).alias("_at"))
    first = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")).where("n > 1")
    again = rows.join(first, "_k").where("_at > _first").groupBy("_k").agg(F.first("n").alias("n"), F.first("_first").alias("first_pos"), F.min("_at").alias("second_pos"))
    return again.orderBy("second_pos").limit(most).withColumnRenamed("_k", key)


def overlap_examples(left: DataFrame, right: DataFrame, most: int = 10, key: str = "index") -> DataFrame:
    """Keys of one side alone: the first of each side, sorted as text."""
    a = left.select(X.key_text(F.col(key)).alias("k")).where("k is not null").distinct()
    b = right.select(X.key_text(F.col(key)).alias("k")).where("k is not null").distinct()
    one = lambda x, y, side: x.join(y, "k", "left_anti").orderBy("k").limit(most).select(F.lit(side).alias("side"), F.col("k").alias(key))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def key_overlap(left: DataFrame, right: DataFrame, key: str = "index") -> DataFrame:
    """Sizes of the common and the one-sided keys, and whether the sets are equal, from one full join of distinct keys."""
    a = left.select(X.key_text(F.col(key)).alias("k")).where("k is not null").distinct().withColumn("l", F.lit(1))
    b = right.select(X.key_text(F.col(key)).alias("k")).where("k is not null").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "k", "full")
    out = both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    return out.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def multi_box_totals(df: DataFrame, split: str = "split", column: str = "solution") -> DataFrame:
    """Rows and rows with several boxes by split, and for all (``<all>``)."""
    marked = df.select(X.label(F.col(split)).alias("split"), (X.boxed_count(F.col(column)) > 1).alias("multi"))
    sums = marked.rollup("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if("multi").alias("multi_rows"), F.grouping("split").alias("g"))
    return sums.select(F.when(F.col("g") == 1, F.lit("<all>")).otherwise(F.col("split")).alias("split"), "rows", "multi_rows")


def review_records(df: DataFrame, hints: DataFrame, checked: bool = True) -> DataFrame:
    """index, question, final_answer and hint of each row that must have one."""
    require_columns(df, "index", "question", "final_answer")
    require_columns(hints, "index", "detailed_method_hint")
    if checked:
        require_unique(df, "index")
        require_unique(hints, "index")
        require_keys(df, hints)
    return df.join(hints.select("index", F.col("detailed_method_hint").alias("hint")), "index").select(*[c for c in ("_pos",) if c in df.columns], "index", "question", "final_answer", "hint")


def fan_out(splits: dict[str, DataFrame]) -> DataFrame:
    """Several splits as one table with a ``split`` column, for one job over all."""
    out = None
    for name, df in splits.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
