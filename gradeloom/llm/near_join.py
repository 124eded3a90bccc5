"""N-gram Jaccard self-join with Bayesian candidate pruning.

Rows with the same set of shingles (runs of five words) form a class, and the join is between classes. A class has 96 MinHash
values of 16 bits; three adjacent ones make a band, and classes that share a band are candidates, looked at in their first
common band alone. At similarity 0.8 a pair shares none of 32 bands with chance 1e-10. Values are compared 16 at a time; after each
step a pair is dropped if, under a uniform prior, the posterior probability of reaching the threshold is below the tolerance.
What is left is verified exactly on the shingle sets.

Pairs are never stored. A band's bucket is split into blocks by count and size; a task compares two blocks (or one with itself) in numpy and says which members
have survivors; a second task gets the sets of just these members, finds the survivors again and verifies them. It gives each member's number of links and a
spanning forest of the links, from which components are found in rounds. A member so travels once for each block of its bucket.

Most pairs of a large group of near copies share an early band. A bucket of several blocks is therefore cut by that first: for each of the first EARLIER
bands below its own, the value that half of its members or more have is found, and members that have the same such values make a part with blocks of its own. Parts
that have one of these values in common need no task, as their pairs share an earlier band. What is left of a bucket is a small share of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

HASHES, ROWS, STEP = 96, 3, 16
THRESHOLD, TOLERANCE = 0.8, 1e-7
#: Members of a block at most, and bytes of their sets.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Bands by whose frequent values a bucket of several blocks is cut, so at most 2 ** EARLIER parts.
EARLIER = 4
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minhash(h: np.ndarray) -> np.ndarray:
    """96 values of 16 bits of a set of shingle hashes."""
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(h), 512):
        np.minimum(least, (h[a : a + 512, None] * _A + _B).min(axis=0), out=least)
    return (C.mix(least) & np.uint64(0xFFFF)).astype("<u2")


def bands_of(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values of some signatures, and their bands as numbers."""
    values = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), HASHES)
    parts = values.reshape(len(sigs), HASHES // ROWS, ROWS).astype(np.uint64)
    return values, sum(parts[:, :, i] << np.uint64(16 * i) for i in range(ROWS))


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> list[int]:
    """After each step of n values, the least number of matches at which P(J >= threshold) is at least the tolerance.

    With a uniform prior that probability is P(Bin(n + 1, threshold) <= matches).
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(values: np.ndarray, lanes: np.ndarray, sizes: np.ndarray, side: np.ndarray, other: int, band: int, threshold: float, need: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members (two arrays, 64 first members at a time) that may reach the threshold and that share no earlier band.

    ``side`` is each member's block; with ``other`` >= 0, pairs are between blocks, else within one.
    """
    left = np.flatnonzero(side != other) if other >= 0 else np.arange(len(lanes))
    right = np.flatnonzero(side == other) if other >= 0 else np.arange(len(lanes))
    for a in range(0, len(left), 64):
        rows = left[a : a + 64]
        ok = lanes[rows, band][:, None] == lanes[right, band][None, :]
        if other < 0:
            ok &= right[None, :] > rows[:, None]
        small, large = np.minimum(sizes[rows][:, None], sizes[right][None, :]), np.maximum(sizes[rows][:, None], sizes[right][None, :])
        ok &= small >= threshold * large
        for k in range(band):
            ok &= lanes[rows, k][:, None] != lanes[right, k][None, :]
        i, j = np.nonzero(ok)
        i, j = rows[i], right[j]
        got = np.zeros(len(i), np.int32)
        for k, least in enumerate(need):
            got += (values[i, k * STEP : (k + 1) * STEP] == values[j, k * STEP : (k + 1) * STEP]).sum(1)
            keep = got >= least
            i, j, got = i[keep], j[keep], got[keep]
        if len(i):
            yield i, j


def part_of(lanes: np.ndarray, heavy: list[tuple[int, int]] | None) -> int:
    """Which of the frequent values (band, value) of its bucket a member has, as bits."""
    return sum(1 << e for e, lane in heavy or () if lanes[e] == lane)


def blocks_of(part: int, r: int, plan: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """The block of a member of a bucket's part, and all blocks that it meets; ``plan`` has the parts and their numbers of blocks."""
    own, met, first = -1, [], 0
    for other, blocks in plan:
        if other == part:
            own = first + r % blocks
        if not other & part:
            met += range(first, first + blocks)
        first += blocks
    return own, met


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i rises) have an exact Jaccard similarity that reaches the threshold. The distinct first members' shingles make a table,
    a column for each; a second member's rows of it add up to what it has in common with all of them."""
    mine, row = np.unique(i, return_inverse=True)
    others, col = np.unique(j, return_inverse=True)
    every = np.unique(np.concatenate([sets[x] for x in mine]))
    table = np.zeros((len(every) + 1, len(mine)), np.int32)  # the last row is for shingles that no first member has
    for c, x in enumerate(mine):
        table[np.searchsorted(every, sets[x]), c] = 1
    common = np.empty((len(others), len(mine)), np.int32)
    sizes = np.array([len(sets[x]) for x in others])
    upto = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(others):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + 40_000, side="right")) - 1)
        part = np.concatenate([sets[x] for x in others[a:b]])
        at = np.searchsorted(every, part)
        at[every[np.minimum(at, len(every) - 1)] != part] = len(every)
        common[a:b] = np.add.reduceat(table[at], upto[a:b] - upto[a], axis=0)
        a = b
    got = common[col, row]
    return got >= threshold * (sizes[col] + np.array([len(sets[x]) for x in mine])[row] - got) - 1e-9


def near_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id, n_links, set_id, n_same, n_set_links, and _th (hash of the text).

    class_id is the least id of the row's connected component; n_links counts the other rows whose similarity reaches the threshold, copies
    included; set_id is the least id with the same shingles and n_same the number of such rows; n_set_links counts links to
    other sets. A text of one to four words is one shingle. Rows without words (null, empty) or with a null id are alone: n_links 0, and
    class_id is their own id. Rows that repeat count as rows. An empty table gives no rows; other columns are ignored.
    """
    C.text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("_k"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ths, texts in C.rows_of(batches, "_k", "_th", "t"):
            for a in range(0, len(keys), 1000):
                ids, hs, sizes, sigs = [], [], [], []
                for k, t in zip(keys[a : a + 1000], texts[a : a + 1000], strict=True):
                    h = C.shingles(t) if k is not None else np.empty(0, np.uint64)
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    ids.append(int.from_bytes(d[:8], "little", signed=True))
                    hs.append(int.from_bytes(d[8:], "little", signed=True))
                    sizes.append(len(h))
                    sigs.append(minhash(h).tobytes() if len(h) else None)
                yield C.batch(_k=pa.array(keys[a : a + 1000], pa.int64()), _th=pa.array(ths[a : a + 1000], pa.int64()), c1=pa.array(ids), c2=pa.array(hs), n=pa.array(sizes, pa.int32()), sig=pa.array(sigs, pa.binary()))

    signed = C.saved(base.mapInArrow(sign, "_k long, _th long, c1 long, c2 long, n int, sig binary"))
    reps = signed.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("_k", "_th")).alias("d"), F.count(F.lit(1)).alias("same"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = C.saved(reps.select("c1", "c2", F.col("d._k").alias("_k"), F.col("d._th").alias("_th"), "same", "n", "sig", F.monotonically_increasing_id().alias("r")))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.arange(HASHES // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for rs, ns, sigs in C.rows_of(batches, "r", "n", "sig"):
            lanes = bands_of(sigs)[1]
            yield C.batch(kb=pa.array(C.mix(C.mix(lanes) + width).ravel().view(np.int64)), r=pa.array(np.repeat(np.array(rs, np.int64), lanes.shape[1])), n=pa.array(np.repeat(np.array(ns, np.int32), lanes.shape[1])), band=pa.array(np.tile(np.arange(lanes.shape[1], dtype=np.int8), len(rs))))

    banded = reps.select("r", "n", "sig").mapInArrow(bands, "kb long, r long, n int, band byte")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("nb")
    # counted apart and joined, so that a bucket of very many members is combined in tasks and split as a skewed key
    shared = banded.groupBy("kb").agg(F.count(F.lit(1)).alias("c"), count).where("c > 1").drop("c")
    found = C.saved(banded.join(shared, "kb").select("r", "kb", "band", "nb"))
    seats = found.where("nb = 1 or band = 0").groupBy("r").agg(F.collect_list(F.struct("kb", "band", "nb")).alias("seats"))  # one for each band at most

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kbs, band, sigs in C.rows_of(batches, "kb", "band", "sig"):
            below = np.minimum(np.array(band, np.int64), EARLIER)
            on = np.arange(EARLIER)[None, :] < below[:, None]
            yield C.batch(kb=pa.array(np.repeat(np.array(kbs, np.int64), below)), e=pa.array(np.nonzero(on)[1]), lane=pa.array(bands_of(sigs)[1][:, :EARLIER][on].view(np.int64)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kbs, band, rs, ns, sigs, heavy in C.rows_of(batches, "kb", "band", "r", "n", "sig", "heavy"):
            lanes = bands_of(sigs)[1][:, :EARLIER].view(np.int64).tolist()
            ps = [part_of(x, h and [(v["e"], v["lane"]) for v in h]) for x, h in zip(lanes, heavy, strict=True)]
            yield C.batch(kb=pa.array(kbs, pa.int64()), band=pa.array(band, pa.int32()), r=pa.array(rs, pa.int64()), n=pa.array(ns, pa.int32()), p=pa.array(ps, pa.int32()))

    large = found.where("nb > 1 and band > 0").select("r", "kb", F.col("band").cast("int").alias("band")).join(reps.select("r", "n", "sig"), "r")
    often = large.select("kb", "band", "sig").mapInArrow(early, "kb long, e long, lane long").groupBy("kb", "e", "lane").agg(F.count(F.lit(1)).alias("m"))
    often = often.groupBy("kb", "e").agg(F.max(F.struct("m", "lane")).alias("top"), F.sum("m").alias("c")).where("2 * top.m >= c")
    often = C.saved(often.groupBy("kb").agg(F.collect_list(F.struct("e", F.col("top.lane").alias("lane"))).alias("heavy")))
    parts = C.saved(large.join(C.small(often), "kb", "left").mapInArrow(part, "kb long, band int, r long, n int, p int"))
    plan = C.saved(parts.groupBy("kb", "p").agg(count).groupBy("kb").agg(F.sort_array(F.collect_list(F.struct("p", "nb"))).alias("plan")))  # 2 ** EARLIER at most

    def told(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return C.batch(**{c: pa.array(v, kind) for c, v, kind in zip(("t", "r", "band", "own", "other", "n", "sig"), cols, kinds, strict=True)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rs, ns, sigs, seated in C.rows_of(batches, "r", "n", "sig", "seats"):
            for a in range(0, len(rs), 200):
                out: list[tuple] = []
                for r, n, sig, seats in zip(rs[a : a + 200], ns[a : a + 200], sigs[a : a + 200], seated[a : a + 200], strict=True):
                    for s in seats:
                        nb = s["nb"]
                        own = r % nb
                        out += [(f"{s['kb']}/{min(own, o)}/{max(own, o)}", r, s["band"], own, o if o != own else -1, n, sig) for o in range(nb)]
                yield told(out)

    def deal_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kbs, band, rs, ns, ps, plans, sigs in C.rows_of(batches, "kb", "band", "r", "n", "p", "plan", "sig"):
            for a in range(0, len(rs), 200):
                out: list[tuple] = []
                for kb, bd, r, n, p, pl, sig in zip(*(x[a : a + 200] for x in (kbs, band, rs, ns, ps, plans, sigs)), strict=True):
                    own, met = blocks_of(p, r, [(x["p"], x["nb"]) for x in pl])
                    out += [(f"{kb}/{min(own, o)}/{max(own, o)}", r, bd, own, o if o != own else -1, n, sig) for o in met]
                yield told(out)

    seated = "t string, r long, band int, own int, other int, n int, sig binary"
    dealt = reps.select("r", "n", "sig").join(seats, "r").mapInArrow(deal, seated)
    dealt = dealt.union(parts.join(C.small(plan), "kb").join(reps.select("r", "sig"), "r").mapInArrow(deal_parts, seated))
    dealt = dealt.repartition("t").sortWithinPartitions("t", "r")
    need = least_matches(threshold, tolerance)

    def pairs(sigs: list[bytes], ns: list[int], own: list[int], other: list[int], band: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        across = max(own) if max(other) >= 0 else -1
        return survivors(*bands_of(sigs), np.array(ns), np.array(own), across, band[0], threshold, need)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, rs, band, own, other, ns, sigs in C.groups(batches, "t", "r", "band", "own", "other", "n", "sig"):
            if len(rs) < 2:
                continue
            hit = np.zeros(len(rs), bool)
            for i, j in pairs(sigs, ns, own, other, band):
                hit[i] = hit[j] = True
            on = np.flatnonzero(hit).tolist()
            cols = ([rs[x] for x in on], *([c[x] for x in on] for c in (band, own, other)))
            yield C.batch(t=pa.array([t] * len(on), pa.string()), **{c: pa.array(v, kind) for c, v, kind in zip(("r", "band", "own", "other"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)})

    pruned = C.saved(dealt.mapInArrow(prune, "t string, r long, band int, own int, other int"))
    wanted = C.saved(reps.select("r", "_k", "_th", "same", "sig").join(pruned.select("r").distinct(), "r"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rs, same, sigs, texts in C.rows_of(batches, "r", "same", "sig", "t"):
            for a in range(0, len(rs), 500):
                yield C.batch(r=pa.array(rs[a : a + 500], pa.int64()), same=pa.array(same[a : a + 500], pa.int64()), sig=pa.array(sigs[a : a + 500], pa.binary()), s=pa.array([C.shingles(t).tobytes() for t in texts[a : a + 500]], pa.binary()))

    sets = base.join(C.small(wanted), ["_k", "_th"]).mapInArrow(gather, "r long, same long, sig binary, s binary").dropDuplicates(["r"])
    full = pruned.join(sets, "r").repartition("t").sortWithinPartitions("t", "r")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rs, same, band, own, other, sigs, raw in C.groups(batches, "t", "r", "same", "band", "own", "other", "sig", "s"):
            sets, copies = [np.frombuffer(x, np.uint64) for x in raw], np.array(same)
            links, rows, root = np.zeros(len(rs), np.int64), np.zeros(len(rs), np.int64), np.arange(len(rs))
            for i, j in pairs(sigs, [len(x) for x in sets], own, other, band):
                ok = verified(sets, i, j, threshold)
                i, j = i[ok], j[ok]
                np.add.at(links, i, 1)
                np.add.at(links, j, 1)
                np.add.at(rows, i, copies[j])
                np.add.at(rows, j, copies[i])
                cut = np.flatnonzero(np.diff(i)) + 1
                for x, js in zip(i[np.concatenate(([0], cut))].tolist() if len(i) else [], np.split(j, cut), strict=False):
                    of = root[js]
                    low = min(root[x], of.min())
                    if root[x] != low or (of != low).any():
                        root[np.isin(root, np.append(of, root[x]))] = low
            on = np.flatnonzero(links)
            if len(on):
                yield C.batch(r=pa.array([rs[x] for x in on], pa.int64()), v=pa.array([rs[root[x]] for x in on], pa.int64()), links=pa.array(links[on]), rows=pa.array(rows[on]))

    linked = C.saved(full.mapInArrow(verify, "r long, v long, links long, rows long"))
    number = linked.groupBy("r").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))
    label = components(linked.select(F.col("r").alias("u"), "v").where("u <> v").distinct())
    known = number.join(label.withColumnRenamed("u", "r"), "r", "left").withColumn("v", F.coalesce("v", "r"))
    known = known.join(reps.select("r", "_k"), "r")
    least = known.groupBy("v").agg(F.min("_k").alias("class_id"))
    known = C.saved(known.join(least, "v").select("r", "links", "rows", "class_id"))

    named = reps.select("c1", "c2", "r", F.col("_k").alias("set_id"), "same").join(C.small(known), "r", "left")
    out = signed.select("_k", "_th", F.when(F.col("n") > 0, F.col("c1")).otherwise(F.xxhash64("_k", "_th")).alias("c1"), "c2").join(named, ["c1", "c2"], "left")
    return out.select(
        F.col("_k").alias("doc_id"), F.coalesce("class_id", "set_id", "_k").alias("class_id"), (F.coalesce("rows", F.lit(0)) + F.coalesce("same", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("set_id", "_k").alias("set_id"), F.coalesce("same", F.lit(1)).cast("long").alias("n_same"), F.coalesce("links", F.lit(0)).cast("long").alias("n_set_links"), "_th",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; rows without words or with a null id stay."""
    found = near_join(docs, id_col=id_col, text_col=text_col, **options)
    spare = C.saved(found.where("doc_id is not null and (doc_id <> class_id or n_same > 1)").select("doc_id", "_th", "class_id"))
    gone = C.small(C.saved(spare.where("doc_id <> class_id").select(F.col("doc_id").alias("__gl_gk"), F.col("_th").alias("__gl_gt")).distinct()))
    left = docs.join(gone, (F.col(id_col).cast("long") == F.col("__gl_gk")) & (F.xxhash64(F.col(text_col)) == F.col("__gl_gt")), "left_anti")
    # rows that share the least id of their class are rows that repeat: one of them stays
    twice = C.saved(spare.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("__gl_gk")))
    if not twice.take(1):
        return left
    again = F.col(id_col).cast("long") == F.col("__gl_gk")
    return left.join(C.small(twice), again, "left_anti").unionByName(left.join(C.small(twice), again, "left_semi").dropDuplicates([id_col]))


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(C.documents(spark, sf_dir)).drop("_th")
