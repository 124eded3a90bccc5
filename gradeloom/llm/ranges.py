"""Rows in the order of a key, dealt to ranges of about equal weight, and running sums along an order.

A plan holds at most a few times MOST ranges, at any size of the table: beyond that, ranges grow instead. It is found from histograms that
are refined only where a bin is too heavy. A single id that is too heavy (all null ids count as one) is split by a second,
16-bit key, so that no value can fill a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Ranges that a plan aims at, at most, and bins of its first histogram.
MOST, BINS = 1 << 16, 1 << 12
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class RangePlan:
    """Ranges 0 .. ``size`` - 1 of ids in ascending order, null ids last. Group g holds the ids from ``lows[g]`` to the next one's low, in
    ``splits[g]`` ranges by the second key; more than one only where the group is a single id."""

    def __init__(self, lows: list[int], splits: list[int], null_splits: int):
        self.lows, self.splits = np.array(lows, np.int64), np.array([*splits, null_splits], np.int64)
        self.first = np.cumsum(self.splits) - self.splits
        self.known = int(self.first[-1])
        self.size = self.known + null_splits

    def ranks(self, keys: pa.Array, subs: np.ndarray) -> np.ndarray:
        """The range of each id, the second key (0 .. 65535) deciding within an id."""
        group = self._groups(keys)
        return self.first[group] + (subs.astype(np.int64) * self.splits[group] >> 16)

    def ranks_down(self, keys: pa.Array, subs: np.ndarray) -> np.ndarray:
        """As :meth:`ranks`, with ids in descending order and null ids last again; the second key still ascends within an id."""
        group = self._groups(keys)
        within = subs.astype(np.int64) * self.splits[group] >> 16
        return np.where(group == len(self.lows), self.known + within, self.known - self.first[group] - self.splits[group] + within)

    def _groups(self, keys: pa.Array) -> np.ndarray:
        k = keys.fill_null(0).to_numpy(zero_copy_only=False)
        group = np.maximum(np.searchsorted(self.lows, k, side="right") - 1, 0)
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), len(self.lows), group)


def plan_ranges(rows: DataFrame, target: int, most: int = MOST, bins: int = BINS) -> RangePlan:
    """A plan for a saved table of k (id, may be null) and w (weight): ranges of about ``target``, or more if these would be over ``most``."""
    at = rows.agg(F.min("k"), F.max("k"), F.sum("w"), F.sum(F.when(F.col("k").isNull(), F.col("w")))).first()
    low, high, total, null = at[0], at[1], int(at[2] or 0), int(at[3] or 0)
    target = max(1, target, total // most)
    null_splits = min(max(1, -(-null // target)), 1 << 16)
    if low is None:
        return RangePlan([_LOW], [1], null_splits)
    # bins by their lower edge, with their weights; edges[-1] is beyond the greatest id
    edges = sorted({low + (high + 1 - low) * i // bins for i in range(bins)})
    weights = _histogram(rows, edges)
    while True:
        uppers = [*edges[1:], high + 1]
        heavy = [i for i, (a, b, w) in enumerate(zip(edges, uppers, weights, strict=True)) if w > 1.5 * target and b - a > 1]
        if not heavy:
            break
        finer: list[int] = []
        for i in heavy:
            n = min(uppers[i] - edges[i], max(16, 4 * -(-weights[i] // target)))
            finer += [edges[i] + (uppers[i] - edges[i]) * j // n for j in range(n)] + [uppers[i]]
        finer = sorted({x for x in finer if x <= high})
        got = dict(zip(finer, _histogram(rows, finer), strict=True))
        old = dict(zip(edges, weights, strict=True))
        replaced = {edges[i] for i in heavy}
        ends = {uppers[i] for i in heavy}
        old.update({x: got[x] for x in finer if x in replaced or x not in ends})
        edges = sorted(x for x in old if x <= high)
        weights = [old[x] for x in edges]
    lows, splits, held = [], [], 0
    for i, (a, w) in enumerate(zip(edges, weights, strict=True)):
        alone = w > 1.5 * target and (edges[i + 1] if i + 1 < len(edges) else high + 1) - a == 1
        if not lows or alone or splits[-1] > 1 or held + w > target:
            lows.append(a)
            splits.append(min(-(-w // target), 1 << 16) if alone else 1)
            held = 0
        held += w
    return RangePlan(lows, splits, null_splits)


def _histogram(rows: DataFrame, edges: list[int]) -> list[int]:
    """Weights of the ids from each edge to the next, and from the last on."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(edges, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        sums = np.zeros(len(at), np.int64)
        for b in batches:
            k, w = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "w"))
            i = np.searchsorted(at, k, side="right") - 1
            np.add.at(sums, i[i >= 0], w[i >= 0])
        some = np.flatnonzero(sums)
        yield C.batch(b=pa.array(some), w=pa.array(sums[some]))

    out = [0] * len(edges)
    for r in rows.where("k is not null").mapInArrow(count, "b long, w long").groupBy("b").agg(F.sum("w").alias("w")).collect():  # a row for each bin
        out[r["b"]] = int(r["w"])
    return out


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, parts: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) of ``df`` with ``out``: the sum of ``value`` of all rows before in ``order``. Rows are dealt to ranges of the order
    and summed in each; only the ranges' sums are summed over all. The result is read from a saved table."""
    spark = df.sparkSession
    keep = list(dict.fromkeys([*(keep or df.columns), value]))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(v) + before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - v), pa.array(np.full(len(v), part, np.int32))], [*keep, "__gl_local", "__gl_part"])
            before = int(upto[-1]) if len(v) else before

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    local = C.saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*keep).mapInArrow(add, f"{fields}, __gl_local long, __gl_part int"))
    sums, before = [], 0
    for r in sorted(local.groupBy("__gl_part").agg(F.sum(value).alias("s")).collect()):  # a row for each range
        sums.append((r[0], before))
        before += int(r[1])
    offsets = F.broadcast(C.local_table(spark, sums, __gl_part=pa.int32(), __gl_before=pa.int64()))
    return local.join(offsets, "__gl_part").withColumn(out, F.col("__gl_local") + F.col("__gl_before")).drop("__gl_part", "__gl_local", "__gl_before")
