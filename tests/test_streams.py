"""Followed logs and batches in flight, over restarts."""

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradeloom.streaming import checkpoints, followed, in_flight


def line(index, hint="c", code=200, tokens=1):
    body = {"output_text": json.dumps({"concise_hint": hint, "detailed_method_hint": ["m"], "detailed_scaffold_hint": ["s"]}), "usage": {"input_tokens": tokens}}
    return json.dumps({"custom_id": index, "response": {"status_code": code, "body": body}})


def test_followed_log(spark, tmp_path):
    land, log, marks = (str(tmp_path / x) for x in ("land", "log", "marks"))
    (tmp_path / "land").mkdir()

    def put(name, *lines):
        (tmp_path / "land" / name).write_text("\n".join(lines) + "\n")

    def run(per_trigger=1):
        followed.follow(spark, land, log, marks, per_trigger, buckets=4).awaitTermination()
        return {r["index"]: r["concise_hint"] for r in followed.latest(spark, log).collect()}

    put("1.jsonl", line("a", code=500), line("b", "b1"), "broken", "", "[1]")
    assert run() == {"b": "b1"}
    # a success after a failure, a success after a success (in one file, and in a later one), a failure after a success
    put("2.jsonl", line("a", "a2"), line("b", "b2"), line("b", "b3"), line("c", "c1"))
    assert run() == {"a": "a2", "b": "b3", "c": "c1"}
    put("3.jsonl", line("c", "c2"), line("a", code=429))
    put("4.jsonl", "nothing here")
    assert run() == {"a": "a2", "b": "b3", "c": "c2"} == run()
    rows = spark.read.parquet(log)
    assert {r["index"]: r["concise_hint"] for r in checkpoints.latest(rows.drop("batch")).collect()} == run()
    assert rows.where("status = 'error'").count() == 2 and json.loads(rows.where("index = 'a' and status = 'error'").orderBy("_pos").first()["error"])["status_code"] == 500
    sums = followed.totals(spark, log).first()
    assert (sums["batches"], sums["lines"], sums["malformed"], sums["ok"], sums["errors"], sums["input_tokens"]) == (4, 11, 3, 6, 2, 8)


def test_a_batch_that_runs_twice_leaves_the_same(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, k, "ok", "c", "m", "s") for k, i in enumerate(ids)], "index string, _pos long, status string, concise_hint string, detailed_method_hint string, detailed_scaffold_hint string")
    log, top = str(tmp_path), f"{tmp_path}/_latest"
    for number, ids in enumerate([("a", "b"), ("b", "c"), ("d",), ()]):
        for _ in range(2):
            followed._compact(rows(*ids), top, number, 2)
    assert sorted(r["index"] for r in followed.latest(spark, log).collect()) == ["a", "b", "c", "d"]
    # a batch that stopped before its manifest doesn't show
    followed._compact(rows("e"), top, 4, 2)
    (tmp_path / "_latest" / "manifest" / "batch=4" / "_SUCCESS").unlink()
    assert sorted(r["index"] for r in followed.latest(spark, log).collect()) == ["a", "b", "c", "d"]
    followed._compact(rows("e"), top, 4, 2)
    assert followed.latest(spark, log).count() == 5


def ended(rows, most):
    """Checks that steps are without gaps, that no more than ``most`` are open, and that each batch ends at most once, after it was submitted; the final states."""
    by = defaultdict(list)
    for r in rows:
        by[r["job"]].append(r)
    final = {}
    for job, found in by.items():
        found.sort(key=lambda r: r["step"])
        assert [r["step"] for r in found] == list(range(1, len(found) + 1))
        open_ = set()
        for r in found:
            if r["state"] == "submitted":
                assert (job, r["batch"]) not in final and r["batch"] not in open_
                open_.add(r["batch"])
            else:
                open_.remove(r["batch"])
                final[job, r["batch"]] = r["state"]
            assert len(open_) == r["open"] <= most
    return final


def test_batches_in_flight(spark, tmp_path):
    land, out, marks = (str(tmp_path / x) for x in ("land", "out", "marks"))
    (tmp_path / "land").mkdir()
    schema = "job string, batch string, event string, at timestamp"

    def put(name, *events):
        rows = [{"job": j, "batch": b, "event": e, "at": f"2024-01-01T00:{m:02d}:00Z"} for j, b, e, m in events]
        (tmp_path / "land" / name).write_text("\n".join(map(json.dumps, rows)) + "\n")

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(land)
        stream = in_flight.transitions(events, most=4, patience_ms=20 * 60_000)
        stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).start(out, format="parquet", outputMode="append").awaitTermination()
        return spark.read.parquet(out).collect()

    put("1", *[("x", f"b{k}", "queued", 0) for k in range(9)], ("y", "only", "queued", 0))
    rows = run()
    assert ended(rows, 4) == {} and Counter(r["state"] for r in rows) == {"submitted": 5}
    put("2", ("x", "b0", "running", 1), ("x", "b1", "completed", 2), ("x", "b1", "completed", 2), ("x", "b2", "failed", 3), ("x", "b8", "completed", 3), (None, "b0", "failed", 3))
    assert ended(run(), 4) == {("x", "b1"): "completed", ("x", "b2"): "failed"}
    # after a restart: the rest ends or falls silent, as does the other job, which only the clock of the first tells
    put("3", ("x", "b0", "cancelled", 18), ("x", "b4", "completed", 18), ("x", "b5", "running", 19), ("x", "b6", "running", 22), ("x", "b7", "completed", 23))
    put("4", ("x", "b5", "completed", 30), ("x", "b8", "completed", 31), ("x", "b6", "completed", 59))
    put("5", ("z", "late", "queued", 59))
    final = ended(run(), 4)
    assert final["x", "b3"] == "expired" and final["x", "b0"] == "cancelled" and final["y", "only"] == "expired" and final["x", "b6"] == "expired"
    assert set(final) == {("y", "only"), *(("x", f"b{k}") for k in range(9))}
    assert ended(run(), 4) == final


@pytest.mark.parametrize("most", [1, 2, 7])
def test_flights_keep_their_bound(most):
    flight = in_flight.Flight(most, 100)
    for t in range(600):
        flight = in_flight.Flight(most, 100, flight.saved()) if t % 50 == 0 else flight
        flight.hear(f"b{t % 40}" if t < 40 else f"b{t * 7 % 40}", "queued" if t < 40 else ("running", "completed", "failed", "queued")[t % 4] if t < 300 else "running", t)
        assert len(flight.open) <= most and flight.deadline() is None or flight.deadline() > t
