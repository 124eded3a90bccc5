"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern (the set of sources
they belong to); flow networks, one for each set of sources that rows connect, route each pattern's words to the quotas of its sources. The k-th pass over a pattern costs k
- 1 a word, so that repetition is convex in cost and is spread as evenly as the quotas allow. Then
documents are chosen in a seeded order, pass after pass.

All costs lie on the arcs out of the flow's origin, one arc for each pass. The flows that a set of such arcs can carry form
a polymatroid, so adding passes in order of cost and augmenting to a maximum each time gives the least
cost; every step is an ordinary maximum flow (Dinic's).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .ranges import running_sum

class Network:
    """Integer maximum flow that goes on from what is routed when capacities grow."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.arcs)
            level[s], queue = 0, deque([s])
            while queue:
                x = queue.popleft()
                for e in self.arcs[x]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if level[t] < 0:
                return total
            nexts, path = [0] * len(self.arcs), []
            while True:
                x = self.to[path[-1]] if path else s
                if x == t:
                    got = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= got
                        self.room[e ^ 1] += got
                    total += got
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                    continue
                while nexts[x] < len(self.arcs[x]):
                    e = self.arcs[x][nexts[x]]
                    if self.room[e] and level[self.to[e]] == level[x] + 1:
                        break
                    nexts[x] += 1
                if nexts[x] < len(self.arcs[x]):
                    path.append(self.arcs[x][nexts[x]])
                elif path:
                    nexts[self.to[path[-1] ^ 1]] += 1
                    path.pop()
                else:
                    break


def water_fill(sources: DataFrame, total: int, most: int) -> DataFrame:
    """``sources`` (s, size, weight) with targets in proportion to the weights that add up to ``total``; none is above ``most`` times its size, and what is cut
    off is shared by weight among the others until none is above. A source is above if its size by weight is under a mark, which rises until it holds."""
    open_ = sources.where("weight > 0")
    mark, closed = 0.0, 0
    while True:
        over = F.col("size") / F.col("weight") < F.lit(mark)
        at = open_.agg(F.count_if(over), F.sum(F.when(over, F.col("size"))), F.sum(F.when(~over, F.col("weight")))).first()
        left, weight = total - most * int(at[1] or 0), float(at[2] or 0.0)
        if not weight or (mark and at[0] == closed):
            break
        closed, mark = at[0], left / (weight * most)
    rest = F.lit(float(left)) * F.col("weight") / F.lit(weight or 1.0)
    target = F.when(F.col("weight") > 0, F.when(F.col("size") / F.col("weight") < F.lit(mark), F.lit(float(most)) * F.col("size")).otherwise(rest))
    return sources.withColumn("target", F.coalesce(target, F.lit(0.0)))


def route(patterns: list[tuple[tuple, int]], quotas: dict, passes: int) -> list[dict]:
    """Words that each pattern (its sources, its words) gives to each of its sources: the most that the quotas take, at the least repetition."""
    names = list(quotas)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    net = Network(end + 1)
    for s in names:
        net.arc(place[s], end, round(quotas[s]))
    given: list[dict] = []
    for p, (members, size) in enumerate(patterns):
        given.append({s: net.arc(1 + p, place[s], passes * size) for s in members if s in place})
    entry = [net.arc(0, 1 + p, 0) for p in range(len(patterns))]
    for _ in range(passes):
        for p, (_, size) in enumerate(patterns):
            net.room[entry[p]] += size
        net.run(0, end)
    return [{s: net.room[e ^ 1] for s, e in g.items()} for g in given]


def _order(s: str | None) -> tuple:
    return (s is None, s or "")


def _parts(sources: DataFrame) -> int:
    """Ranges to number the sources in: one for each 100,000."""
    return 1 + sources.count() // 100_000


def _plans(patterns: DataFrame, sources: DataFrame, passes: int) -> DataFrame:
    """What each pattern gives to each of its sources, by a flow network for each component: sources that rows share, directly or by way of others, are one."""
    several = patterns.where(F.size("m") > 1).select(F.transform("m", lambda x: F.xxhash64(x)).alias("hs"))
    edges = several.select(F.explode("hs").alias("u"), F.array_min("hs").alias("v")).where("u <> v").distinct()
    label = components(edges) if several.take(1) else None

    def placed(df: DataFrame, source: Column) -> DataFrame:
        df = df.withColumn("c", F.xxhash64(source))
        if label is None:
            return df
        return df.join(label, F.col("c") == F.col("u"), "left").withColumn("c", F.coalesce("v", "c")).drop("u", "v")

    none = F.lit(None).cast
    a = placed(sources, F.col("s")).select("c", F.lit(0).alias("kind"), F.col("s").alias("p"), none("array<string>").alias("m"), none("long").alias("n"), F.col("size").alias("w"), "target")
    b = placed(patterns.where(F.size("m") > 0), F.col("m")[0]).select("c", F.lit(1).alias("kind"), F.col("_p").alias("p"), "m", "n", "w", none("double").alias("target"))
    fields = "_p string, _all long, _n long, source_size long, target double, _spans array<struct<s:string,a:long,b:long>>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("s", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))
        for _, kinds, ps, ms, ns, ws, targets in C.groups(batches, "c", "kind", "p", "m", "n", "w", "target"):
            of = {p: (w, t) for k, p, w, t in zip(kinds, ps, ws, targets, strict=True) if not k}
            rows = sorted((p, m, n, w) for k, p, m, n, w in zip(kinds, ps, ms, ns, ws, strict=True) if k)
            given = route([(tuple(sorted(m, key=_order)), w) for _, m, _, w in rows], {s: of[s][1] for s in sorted(of, key=_order)}, passes)
            out: list[tuple] = []
            for (p, m, n, w), g in zip(rows, given, strict=True):
                at, spans = 0, []
                for s in sorted(g, key=_order):
                    spans.append({"s": s, "a": at, "b": at + g[s]})
                    at += g[s]
                size, target = of[min(m, key=_order)]
                out.append((p, w, C.root_buckets(n), size, float(target), spans))
            kinds_of = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), spans_type)
            yield C.batch(**{c: pa.array(v, k) for c, v, k in zip(("_p", "_all", "_n", "source_size", "target", "_spans"), zip(*out, strict=True), kinds_of, strict=True)})

    flows = a.unionByName(b).repartition("c").sortWithinPartitions("c").mapInArrow(solve, fields)
    alone = patterns.where(F.size("m") == 0).select("_p", F.col("w").alias("_all"), F.lit(1).cast("long").alias("_n"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.array().cast("array<struct<s:string,a:long,b:long>>").alias("_spans"))
    return C.saved(flows.unionByName(alone))


def mix(docs: DataFrame, size: Column, members: Column, weights=None, quotas: dict | None = None, passes: int = 3, seed: int = 9, cut: bool = True, id_col: str = "doc_id", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Chooses what of each row a mix takes.

    ``size`` is a row's words (null or negative: 0), ``members`` an array of its sources (a null
    element is a source of its own; a null or empty array belongs to none and gives nothing).
    ``quotas`` are words by source; without them ``weights`` (a function of a source's number by code point, null
    last, from 0) share out the words of all rows, a source's target ending at ``passes`` times its words.

    Returns the ``keep`` columns (default: id) and size, source_size and target (of the row's first
    source), taken (words, repeats counted, at most ``passes`` times the size), copies (whole copies)
    and taken_by (source, words), their names after ``prefix``. With ``cut`` a pattern's last row may be taken in part, so that
    quotas are met to the word; without it rows are taken whole, by whether their middle lies within.
    Rows that repeat are rows of their own; ties of the seeded order fall by id and size. An empty table gives no rows.

    Patterns and sources are tables, of any number. The network falls into components that share no source, each solved by a task; one takes about 1 KB of memory for
    each of its patterns. A pattern of any size is spread over about the square root of its rows in buckets.
    """
    spark = docs.sparkSession
    keep = keep or [id_col]
    one = lambda m: F.coalesce(F.concat(F.length(m).cast("string"), F.lit(":"), m), F.lit("null"))
    base = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep], F.col(id_col).cast("string").alias("_id"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("_size"), F.sort_array(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))), asc=False).alias("_m"),
    ).withColumn("_p", F.array_join(F.transform("_m", one), "|"))
    patterns = C.saved(base.groupBy("_p").agg(F.first("_m").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("_size").alias("w")))
    sources = patterns.select(F.explode("m").alias("s"), "w").groupBy("s").agg(F.sum("w").alias("size"))
    if quotas is None:
        order = [F.col("s").asc_nulls_last()]
        numbered = running_sum(sources.withColumn("one", F.lit(1).cast("long")), order, "one", "rank", parts=_parts(sources))
        total = int(patterns.where(F.size("m") > 0).agg(F.sum("w")).first()[0] or 0)
        sources = water_fill(numbered.withColumn("weight", weights(F.col("rank")) if weights else F.lit(1.0)), total, passes)
    else:
        given = C.local_table(spark, [(s, float(x)) for s, x in quotas.items()], q=pa.string(), quota=pa.float64())
        sources = sources.join(given, F.col("s").eqNullSafe(F.col("q")), "left").withColumn("target", F.coalesce("quota", F.lit(0.0)))
    plan_df = _plans(patterns, C.saved(sources.select("s", "size", "target")), passes)

    h = C.hash_key(F.col("_id"), seed=seed)
    df = base.drop("_m").join(C.small(plan_df), "_p").withColumn("_h", h).withColumn("_b", C.bucket_of(F.col("_h"), F.col("_n")))
    df = C.prefix_sum(df, ["_p"], "_b", ["_h", "_id", "_size"], "_size", "_at")
    turns = F.sequence(F.lit(0), F.lit(passes - 1))
    begin = lambda k: k * F.col("_all") + F.col("_at")
    if cut:
        part = lambda x, k: F.greatest(F.lit(0), F.least(x["b"], begin(k) + F.col("_size")) - F.greatest(x["a"], begin(k)))
    else:  # the middle, in half words, so that it is an integer; a row without words has none to take
        middle = lambda k: 2 * begin(k) + F.col("_size")
        part = lambda x, k: F.when((middle(k) >= 2 * x["a"]) & (middle(k) < 2 * x["b"]), F.col("_size")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    by = F.transform("_spans", lambda x: F.struct(x["s"].alias("source"), F.aggregate(turns, zero, lambda acc, k: acc + part(x, k)).alias("words")))
    df = df.withColumn("_by", F.filter(by, lambda x: x["words"] > 0)).withColumn("taken", F.aggregate("_by", zero, lambda acc, x: acc + x["words"]))
    copies = F.when(F.col("_size") > 0, F.floor(F.col("taken") / F.col("_size"))).otherwise(F.lit(0)).cast("long")
    found = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("taken"), "copies": copies, "taken_by": F.col("_by")}
    return df.select(*[F.col(f"k_{c}").alias(c) for c in keep], *[v.alias(f"{prefix}{c}") for c, v in found.items()])


def cycle_521(rank: Column) -> Column:
    """Weights 5, 2, 1, again and again."""
    return F.element_at(F.array(*[F.lit(x) for x in (5.0, 2.0, 1.0)]), (rank % 3 + 1).cast("int"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return mix(docs, n_words(F.col("text")), F.array(F.col("source")), cycle_521)
