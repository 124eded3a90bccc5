"""Generation in exact batches with a restart, and quartiles of large groups."""

import math
import random

import pytest

from gradeloom.operators import analyze
from gradeloom.operators.generate import generate


def test_a_restart_asks_only_for_the_rest(spark, tmp_path):
    calls, folder = tmp_path / "calls", tmp_path / "answers"
    calls.mkdir()
    where, broken = str(calls), str(tmp_path / "mended")

    def answer(rows):
        import os
        import uuid

        first = rows[0]["_pos"]
        open(f"{where}/{first}-{len(rows)}-{uuid.uuid4().hex}", "w").close()
        if first == 30 and not os.path.exists(broken):
            raise RuntimeError("out of memory")
        return [{"model_output": f"to {r['question']}", "output_token_length": r["_pos"], "finish_reason": None} for r in rows]

    inputs = spark.range(0, 95, 1, 3).selectExpr("94 - id as _pos", "cast(id as string) as question", "cast(null as string) as hint")
    with pytest.raises(Exception, match="out of memory"):
        generate(inputs, answer, str(folder), batch_size=10)
    open(broken, "w").close()
    out = generate(inputs, answer, str(folder), batch_size=10)
    rows = sorted(out.collect(), key=lambda r: r["_pos"])
    assert [r["_pos"] for r in rows] == list(range(95)) == [r["output_token_length"] for r in rows]
    assert all(r["model_output"] == f"to {94 - r['_pos']}" and r["hint"] is None for r in rows)
    asked = sorted(tuple(map(int, p.name.split("-")[:2])) for p in calls.iterdir())
    assert {n for first, n in asked if first != 90} == {10} and (90, 5) in asked
    twice = [first for first, _ in set(asked) if sum(a == first for a, _ in asked) > 1]
    assert twice in ([], [30])  # the batch that failed alone
    before = len(asked)
    assert generate(inputs, answer, str(folder), batch_size=10).count() == 95 and len(list(calls.iterdir())) == before
    assert generate(inputs.limit(0), answer, str(tmp_path / "none")).count() == 0


def test_answers_must_be_as_many(spark, tmp_path):
    with pytest.raises(Exception, match="1 answers to 3 inputs"):
        generate(spark.range(3).selectExpr("id as _pos"), lambda rows: [{}], str(tmp_path / "a"))


def test_quartiles_of_large_groups_are_the_same(spark):
    rnd = random.Random(4)
    rows = [("hot", rnd.choice([1.0, 1.0, 2.5, 7.0, float("nan"), None])) for _ in range(400)] + [("mixed", rnd.uniform(-9, 9)) for _ in range(331)]
    rows += [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0), ("nan", float("nan")), ("two", -1.0), ("two", 0.5), ("inf", math.inf), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    plain = lambda r: tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r)
    for by in (["g"], None):
        one, many = ({plain(r) for r in analyze.quantiles(df, "v", by, whole).drop("mean").collect()} for whole in (10**6, 3))
        assert one == many
