"""Merkle manifest of a table: hash trees of every group's rows under one root.

A row's leaf is the digest of its fields. Within a group leaves are numbered by ``row_number``; from level to level a node's number is divided
by the fanout, children of a parent are gathered in order and hashed. A group's last node is its subroot; subroots, in the order of their
groups, are leaves of a tree of the same kind, whose last node is the root. Going down again, each level joins its parents and puts the
siblings of every child before what is known of the levels above.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a path is: for every level from the leaf up, the digests left and right of the way.
PATH = "array<struct<l: string, r: string>>"


class Tree(NamedTuple):
    """Levels of parents from the leaves up (g, i, c, h, kids), and the last node of every group (g, h)."""

    levels: list[DataFrame]
    tops: DataFrame


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*fields: Column) -> Column:
    """Digest of the fields in order: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]))


def group_key(group: Column) -> Column:
    """A text that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds i, the row's number in its group g (from 0), and c, the group's rows. Rows are dealt to ranges of (g, order), so that
    a group of any size is numbered by many tasks; only the ranges' counts are summed along a group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = C.saved(rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id()))
    along = Window.partitionBy("g")
    sums = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("m"))
    sums = sums.select("g", "part", (F.sum("m").over(along.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(along).alias("c"))
    within = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))
    return dealt.withColumn("i", within.cast("long")).join(sums, ["g", "part"]).withColumn("i", F.col("i") + F.col("before") - 1).drop("part", "before")


def tree(nodes: DataFrame, carried: list[str], fanout: int = FANOUT) -> Tree:
    """Levels over nodes of g, i, c and h; ``carried`` columns stay with the leaves. A level has a fanout'th of the rows of the one below
    and is saved; groups of one node need no more levels."""
    levels, tops, width = [], [nodes.where("c = 1").select("g", "h")], 1
    most = nodes.agg(F.max("c")).first()[0] or 0
    while most > width:
        kids = F.array_sort(F.collect_list(F.struct("i", "h", *([] if levels else carried))))
        up = nodes.where(F.col("c") > width).groupBy("g", F.expr(f"i div {fanout}").alias("p")).agg(F.max("c").alias("c"), kids.alias("kids"))
        level = C.saved(up.select("g", F.col("p").alias("i"), "c", digest(F.array_join(F.col("kids.h"), "")).alias("h"), "kids"))
        width *= fanout
        levels.append(level)
        tops.append(level.where(F.col("c") <= width).select("g", "h"))
        nodes = level.select("g", "i", "c", "h")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Tree(levels, out)


def paths(t: Tree, alone: DataFrame, above: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """Every leaf of the tree with its ``path``: siblings level by level, then what ``above`` (g, path, ...) has for its group.
    ``alone`` are the leaves of groups of one. Parents travel, not leaves: a level's rows are joined while their children are still together."""
    kept = [c for c in above.columns if c not in ("g", "path")]
    known: DataFrame | None = None
    for depth in range(len(t.levels) - 1, -1, -1):
        level = t.levels[depth].select("g", "i", "c", "kids")
        last = F.col("c") <= fanout ** (depth + 1)
        here = level.where(last).join(above, "g")
        if known is not None:
            here = here.unionByName(level.where(~last).join(known, ["g", "i"]))
        k = F.col("kids.h")
        left, right = (F.array_join(x, "") for x in (F.slice(k, 1, F.col("at")), F.slice(k, F.col("at") + 2, fanout)))
        here = here.select("g", *kept, "path", "kids", F.posexplode("kids").alias("at", "kid"))
        step = F.concat(F.array(F.struct(left.alias("l"), right.alias("r"))), F.col("path")).cast(PATH)
        known = here.select("g", F.col("kid.i").alias("i"), *kept, step.alias("path"), *([] if depth else [F.col("kid.h").alias("h"), *[F.col(f"kid.{c}").alias(c) for c in carried]]))
    single = alone.join(above, "g").select("g", "i", *kept, "path", "h", *carried)
    return single if known is None else single.unionByName(known)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(rows: DataFrame, group: Column, order: list[str], carried: list[str], leaf_col: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``carried`` columns of each row with leaf, subroot, root and path (see :data:`PATH`).

    Within a group rows ascend by ``order`` (nulls first), ties by leaf; rows that are equal in both are equal leaves, whose order doesn't matter. A null
    group is one of its own, first of all. An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    names = [f"k{j}" for j in range(len(order))]
    kept = [f"v{j}" for j in range(len(carried))]
    cols = [F.col(c).alias(n) for c, n in [*zip(order, names, strict=True), *zip(carried, kept, strict=True)]]
    # leaves are narrow: texts are read once, and equal rows are dealt apart by their place
    leaves = C.saved(rows.select(group_key(group).alias("g"), F.col(leaf_col).alias("h"), *cols, F.monotonically_increasing_id().alias("place")))
    nodes = C.saved(numbered(leaves, [*names, "h", "place"]).select("g", "i", "c", "h", *kept))
    groups = tree(nodes, kept, fanout)
    tops = C.saved(groups.tops)
    top_nodes = C.saved(numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), ["of"]).select("g", "i", "c", "h", "of"))
    whole = tree(top_nodes, ["of"], fanout)
    root = whole.tops.first()  # one digest
    start = top_nodes.select("g").distinct().withColumn("path", F.array().cast(PATH))
    above = paths(whole, top_nodes.where("c = 1"), start, ["of"], fanout).select(F.col("of").alias("g"), "path", F.col("h").alias("subroot"))
    out = paths(groups, nodes.where("c = 1"), C.saved(above), kept, fanout)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carried, kept, strict=True)], F.col("h").alias("leaf"), "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"), "path")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id comes first in its source, and is never tampered with."""
    docs = C.documents(spark, sf_dir)
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(*[lowered if f == "text" else F.col(f) for f in FIELDS]))
    rows = docs.select("doc_id", "source", leaf(*[F.col(f) for f in FIELDS]).alias("leaf"), tampered.alias("tampered"))
    out = manifest(rows, F.col("source"), ["doc_id"], ["doc_id", "tampered"])
    found = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
