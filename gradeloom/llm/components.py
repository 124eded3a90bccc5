"""Connected components of an edge table by alternating large and small stars, each round cut off by a saved table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    to = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(to, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    to = _least(down)
    return down.join(to, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(to.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node that has an edge and isn't the least of its component, with that least node."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    now = C.saved(_small(edges))
    before = None
    while before != (at := state(now)):
        before = at
        now = C.saved(_small(_large(now)))
    return now
