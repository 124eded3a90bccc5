"""The occurrence join and distributed numbers against loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradeloom.operators.cursor import occurrence_join
from gradeloom.operators.ranks import numbered


def loop(predictions, generations):
    by = defaultdict(list)
    for key, pos, ds in sorted(generations, key=lambda r: r[1]):
        by[key].append((pos, ds or ""))
    at, out = defaultdict(int), {}
    for key, pos, ds in sorted(predictions, key=lambda r: r[1]):
        rows = by[key] if key is not None else []
        if not rows:
            out[pos] = None
            continue
        hit = next((j for j in range(at[key], len(rows)) if ds and rows[j][1] == ds), None)
        hit = at[key] if hit is None else hit
        out[pos] = rows[min(hit, len(rows) - 1)][0]
        if hit < len(rows):
            at[key] = hit + 1
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "index string, _pos long, dataset string").repartition(3)


SHAPES = {
    "alike": lambda rnd, n: (["a"] * n, ["a"] * n),
    "mixed": lambda rnd, n: ([rnd.choice("abc") for _ in range(n)], [rnd.choice("abc") for _ in range(n)]),
    "skipping": lambda rnd, n: ([rnd.choice("ab") for _ in range(n // 3)], [rnd.choice("aaaaaaac") + rnd.choice(["", "x"]) for _ in range(2 * n)]),
    "few generations": lambda rnd, n: ([rnd.choice("ab") for _ in range(n)], ["b", "a", "b"]),
    "far ahead": lambda rnd, n: (["a", "z", None, "", "a"] * (n // 5), ["a"] * n + ["z"] * 3 + ["a"] * n),
    "strangers": lambda rnd, n: (["q"] * n, [None, "", "a"] * (n // 3)),
}


@pytest.mark.parametrize("name", SHAPES)
def test_occurrence_join(spark, name):
    """An index far over the block's size among small, single and lacking ones."""
    rnd = random.Random(3)
    wants, datasets = SHAPES[name](rnd, 60)
    positions = rnd.sample(range(10_000), len(wants) + len(datasets))
    p = [("hot", pos, ds) for pos, ds in zip(positions, wants, strict=False)]
    g = [("hot", pos, ds) for pos, ds in zip(sorted(positions[len(wants) :]), datasets, strict=True)]
    for k in range(12):
        p += [(f"k{k}", 20_000 + 100 * k + x, rnd.choice(["a", "b", None])) for x in range(rnd.randrange(1, 6))]
        g += [(f"k{k}", 30_000 + 100 * k + x, rnd.choice(["a", "b", None])) for x in range(rnd.randrange(0, 5))]
    p += [(None, 50_000, "a"), ("none", 50_001, "a")]
    g += [(None, 60_000, "a"), ("other", 60_001, "a"), ("other", 60_002, "a")]
    got = occurrence_join(table(spark, p), table(spark, g), block=7).collect()
    assert len(got) == len(p)
    assert {r["p_pos"]: r["g_pos"] for r in got} == loop(p, g)


def test_occurrence_join_of_a_hot_index(spark):
    """A million rows of one index in eight blocks, equal to the loop."""
    n = 500_000
    rnd = random.Random(1)
    wants, datasets = ([rnd.choice("abcd") for _ in range(n)] for _ in range(2))
    for k in range(0, n, 3):
        datasets[k] = wants[k]
    ds = F.element_at(F.array(*map(F.lit, "abcd")), F.col("d"))
    frames = []
    for values in (wants, datasets):
        codes = spark.sparkContext.broadcast(bytes("abcd".index(v) + 1 for v in values))

        def code(batches, codes=codes):
            for b in batches:
                yield b.assign(d=[codes.value[i] for i in b["id"]])

        frames.append(spark.range(n).mapInPandas(code, "id long, d int").select(F.lit("hot").alias("index"), F.col("id").alias("_pos"), ds.alias("dataset")))
    got = {r["p_pos"]: r["g_pos"] for r in occurrence_join(*frames, block=62_500).collect()}
    from gradeloom.operators.cursor import _places, follow

    assert got == dict(enumerate(follow(wants, _places(datasets), 0, n)))


@pytest.mark.parametrize("group", [[], ["g"]])
def test_numbered(spark, group):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([1, 1, 1, 2, 3, None])) for _ in range(500)] + [("lone", 5)]
    out = numbered(spark.createDataFrame(rows, "g string, v int").repartition(5), ["v"], group).collect()
    by = defaultdict(list)
    for r in out:
        by[r["g"] if group else 0].append(r)
    assert len(out) == len(rows)
    for found in by.values():
        found.sort(key=lambda r: r["_n"])
        assert [r["_n"] for r in found] == list(range(1, len(found) + 1)) and {r["_of"] for r in found} == {len(found)}
        values = [(r["v"] is not None, r["v"] or 0) for r in found]
        assert values == sorted(values)
    assert numbered(spark.createDataFrame([], "g string, v int"), ["v"], group).count() == 0
