"""The occurrence join: predictions follow a cursor along the generations of their index.

A prediction takes the next generation of its dataset at or behind the cursor, else the one at the cursor, else the last one; the cursor goes behind what was
taken. Indexes of few rows are followed whole, a group each. An index of more than ``block`` rows is cut in blocks of predictions that start at a guess of their
cursor: as every step moves it by one at least, the number of predictions before is a lower bound, and right where none is skipped. All blocks run
at once, each against the blocks of generations that its cursor reaches. A block whose start isn't where the one before ended runs again from there, until
none is left: the first blocks are right after a round, so the rounds end.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.sources.saved import saved

from .ranks import numbered

#: Predictions of a block, and generations that it sees at a time (twice as many).
BLOCK = 100_000
ROUND = "_key string, pb long, version long, p_pos long, j long, k long, at long, want string"


def follow(wants: list[str], places: dict[str, list[int]], at: int, size: int) -> list[int]:
    """The place that each prediction takes of ``size`` generations, with the cursor at ``at``."""
    last, out = size - 1, []
    for want in wants:
        there = places.get(want, []) if want else []
        i = bisect_left(there, at)
        hit = there[i] if i < len(there) else at
        out.append(min(hit, last))
        at = hit + 1 if hit <= last else at
    return out


def _places(datasets: list[str], first: int = 0) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, ds in enumerate(datasets, first):
        out.setdefault(ds, []).append(i)
    return out


def _whole(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    left, right = left.sort_values("p_pos"), right.sort_values("g_pos")
    hits = follow(left["ds"].tolist(), _places(right["ds"].tolist()), 0, len(right))
    return pd.DataFrame({"p_pos": left["p_pos"].to_numpy(), "g_pos": right["g_pos"].to_numpy()[hits]})


def _part(block: int):
    """Follows a block's predictions as far as the generations at hand (two blocks of them) decide."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("i"), right.sort_values("j")
        at, size = int(left["at"].iloc[0]), int(left["of"].iloc[0])
        k, version = int(left["k"].iloc[0]), int(left["version"].iloc[0])
        end = min(size, (at // block + 2) * block)
        places = _places(right["ds"].tolist(), at // block * block)
        out, stuck = [], None
        for want, last in zip(left["ds"].tolist(), left["last"].tolist(), strict=True):
            if at >= size:
                break
            hit = at
            if want and last >= at:
                there = places.get(want, [])
                i = bisect_left(there, at)
                if i == len(there):
                    stuck = want  # the next one is further on
                    break
                hit = there[i]
            elif at >= end:
                break
            out.append(hit)
            at = hit + 1
        if at >= size:  # the cursor has passed all generations
            out += [size - 1] * (len(left) - len(out))
        state = pd.DataFrame({"p_pos": [None], "j": [None], "k": [k + len(out)], "at": [at], "want": [stuck]})
        rows = pd.DataFrame({"p_pos": left["p_pos"].to_numpy()[: len(out)], "j": np.array(out, np.int64)})
        both = pd.concat([rows.astype("Int64"), state.astype({"p_pos": "Int64", "j": "Int64", "k": "Int64", "at": "Int64"})])
        return both.assign(_key=key[0], pb=key[1], version=version)[["_key", "pb", "version", "p_pos", "j", "k", "at", "want"]]

    return run


def _hot(p: DataFrame, g: DataFrame, block: int) -> DataFrame:
    """p_pos and g_pos of indexes of any size."""
    gens = saved(numbered(g, ["g_pos"], ["_key"], "j", "of").withColumn("j", F.col("j") - 1).withColumn("gb", F.expr(f"j div {block}")))
    seen = saved(gens.groupBy("_key", "ds", "gb").agg(F.min("j").alias("first"), F.max("j").alias("last")))
    lasts = seen.groupBy("_key", "ds").agg(F.max("last").alias("last"))
    preds = numbered(p, ["p_pos"], ["_key"], "i", "n_p").withColumn("i", F.col("i") - 1).withColumn("pb", F.expr(f"i div {block}"))
    preds = saved(preds.join(lasts, ["_key", "ds"], "left").withColumn("last", F.coalesce("last", F.lit(-1).cast("long"))))
    sizes = gens.groupBy("_key").agg(F.count(F.lit(1)).alias("of"))
    start = F.least(F.col("of"), F.col("pb") * block)
    state = preds.groupBy("_key", "pb").agg(F.count(F.lit(1)).alias("n")).join(sizes, "_key")
    state = saved(state.select("_key", "pb", "n", "of", start.alias("start"), F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("k"), start.alias("at")))
    found: DataFrame | None = None
    while True:
        run = state.where("k < n")
        left = preds.join(run.select("_key", "pb", "of", "version", "k", "at"), ["_key", "pb"]).where(F.col("i") >= F.col("pb") * block + F.col("k"))
        reach = run.select("_key", "pb", F.explode(F.array(F.expr(f"at div {block}"), F.expr(f"at div {block} + 1"))).alias("gb"))
        right = gens.join(reach, ["_key", "gb"]).select("_key", "pb", "j", "ds")
        got = saved(left.groupBy("_key", "pb").cogroup(right.groupBy("_key", "pb")).applyInPandas(_part(block), ROUND))
        rows = got.where("p_pos is not null").select("_key", "pb", "version", "p_pos", "j")
        found = rows if found is None else found.unionByName(rows)
        # a block that ran out of generations goes on where its next dataset is
        ends = got.where("k is not null").select("_key", "pb", F.col("k").alias("new_k"), F.col("at").alias("new_at"), "want")
        ahead = ends.where("want is not null").join(seen.withColumnRenamed("ds", "want"), ["_key", "want"]).where("first >= new_at").groupBy("_key", "pb").agg(F.min("first").alias("next_at"))
        moved = state.join(ends.drop("want"), ["_key", "pb"], "left").join(ahead, ["_key", "pb"], "left")
        moved = moved.select("_key", "pb", "n", "of", "start", "version", F.coalesce("new_k", "k").alias("k"), F.coalesce("next_at", "new_at", "at").alias("at"))
        # a block that began elsewhere than the one before has ended begins again
        before = moved.where("k = n").select("_key", (F.col("pb") + 1).alias("pb"), F.col("at").alias("due"))
        wrong = F.coalesce(F.col("due") != F.col("start"), F.lit(False))
        state = saved(
            moved.join(before, ["_key", "pb"], "left").select(
                "_key", "pb", "n", "of", F.when(wrong, F.col("due")).otherwise(F.col("start")).alias("start"), (F.col("version") + wrong.cast("long")).alias("version"),
                F.when(wrong, 0).otherwise(F.col("k")).cast("long").alias("k"), F.when(wrong, F.col("due")).otherwise(F.col("at")).alias("at"),
            )
        )
        if not state.where("k < n").limit(1).count():
            break
    kept = found.join(state.select("_key", "pb", "version"), ["_key", "pb", "version"])
    return kept.join(gens.select("_key", "j", "g_pos"), ["_key", "j"]).select("p_pos", "g_pos")


def occurrence_join(predictions: DataFrame, generations: DataFrame, block: int = BLOCK) -> DataFrame:
    """p_pos and g_pos of each prediction (null where its index has no generation). Rows are identified by ``_pos``.

    Where an index has just one generation, the cursor can't matter and an ordinary join does. A null dataset is the empty one, which takes what is at the cursor;
    a null index has no generations.
    """
    p = predictions.select(X.key_text(F.col("index")).alias("_key"), F.col("_pos").alias("p_pos"), X.to_text(F.col("dataset")).alias("ds"))
    g = generations.select(X.key_text(F.col("index")).alias("_key"), F.col("_pos").alias("g_pos"), X.to_text(F.col("dataset")).alias("ds"))
    sizes = g.groupBy("_key").agg(F.count(F.lit(1)).alias("n_g"), F.min("g_pos").alias("g_pos")).join(p.groupBy("_key").agg(F.count(F.lit(1)).alias("n_p")), "_key", "left")
    sizes = saved(sizes.where("_key is not null"))
    easy = p.join(sizes.where("n_g = 1"), "_key").select("p_pos", "g_pos")
    none = p.join(sizes, "_key", "left_anti").select("p_pos", F.lit(None).cast("long").alias("g_pos"))
    many = sizes.where("n_g > 1 and n_p is not null")
    small = many.where(F.greatest("n_g", "n_p") <= block).select("_key")
    whole = p.join(small, "_key", "left_semi").groupBy("_key").cogroup(g.join(small, "_key", "left_semi").groupBy("_key")).applyInPandas(_whole, "p_pos long, g_pos long")
    out = easy.unionByName(none).unionByName(whole)
    large = many.where(F.greatest("n_g", "n_p") > block).select("_key")
    if large.limit(1).count():
        out = out.unionByName(_hot(p.join(large, "_key", "left_semi"), g.join(large, "_key", "left_semi"), block))
    return out
