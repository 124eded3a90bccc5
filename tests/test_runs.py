"""Positions, files, reports and command lines."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom import cli, runs
from gradeloom.functions import exprs as X
from gradeloom.functions import prompts as P
from gradeloom.operators import analyze, curate, grade, prepare, reports
from gradeloom.sources import readers, writers
from gradeloom.sources.one_file import write_one_file
from gradeloom.streaming import checkpoints


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_positions_over_files_and_splits(spark, tmp_path, small_splits):
    want, folder = [], tmp_path / "lines"
    folder.mkdir()
    for name in ("b", "a", "c"):
        rows = [f"{name}{i}" for i in range(150)]
        (folder / f"{name}.jsonl").write_text("".join(json.dumps({"index": r, "pad": "x" * 20}) + "\n" + "\n" * (i % 3) for i, r in enumerate(rows)))
    want = [f"{name}{i}" for name in "abc" for i in range(150)]
    lines = readers.json_lines(spark, str(folder))
    assert lines.rdd.getNumPartitions() > 3
    assert [r[0] for r in lines.orderBy("_pos").select(readers.field("_v", "index")).collect()] == want
    assert sorted(r["_pos"] for r in lines.select("_pos").collect()) == list(range(450))
    for i, name in enumerate(("z", "y", "x")):
        spark.range(100 * i, 100 * i + 100, 1, 1).write.parquet(str(tmp_path / "t" / name))
    df = readers.positioned(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "t")))
    assert [r["id"] for r in df.orderBy("_pos").collect()] == [*range(200, 300), *range(100, 200), *range(100)]
    assert sorted(r["_pos"] for r in df.collect()) == list(range(300))
    inputs = prepare.inference_inputs(df.where("id % 2 = 0").withColumn("question", F.lit("q")))
    assert sorted(int(r["index"]) for r in inputs.collect()) == [i for i in range(300) if i % 2 == 0]


def test_duplicates_by_their_second_place(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2), ("a", 3), (None, 4), (None, 5), ("c", 6)], "index string, _pos long")
    assert [tuple(r) for r in curate.duplicate_examples(df).collect()] == [("b", 2, 1, 2), ("a", 2, 0, 3)]
    assert [tuple(r) for r in curate.overlap_examples(df, df.where("index = 'a'"), 1).collect()] == [("left", "b")]


def test_documents_and_checks(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"index": 1}')
    with pytest.raises(ValueError, match="no JSON list"):
        readers.records(spark, str(tmp_path / "one.json"))
    (tmp_path / "list.json").write_text('[{"index": 1}, {"index": 2}]')
    assert [r["_pos"] for r in readers.records(spark, str(tmp_path / "list.json")).orderBy("index").collect()] == [0, 1]
    with pytest.raises(ValueError, match="unsupported"):
        readers.records(spark, "x.csv")
    with pytest.raises(Exception, match="no index"):
        readers.generations(spark.createDataFrame([(None,)], "index string")).collect()
    with pytest.raises(ValueError, match="duplicate"):
        readers.train_tokens(spark.createDataFrame([("1", 2), ("1", 3)], "index string, train_token int"))
    got = readers.train_tokens(spark.createDataFrame([("1", None)], "index string, train_token int")).first()
    assert got["train_token"] != got["train_token"]
    (tmp_path / "keys.txt").write_text("b\na\nb\n")
    assert sorted(r[0] for r in readers.key_set(spark, str(tmp_path / "keys.txt")).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="txt"):
        readers.key_set(spark, "keys.csv", words_only=True)
    assert readers.preference_triples(spark.createDataFrame([("p", "c", "r"), ("p", None, "r")], "prompt string, chosen string, rejected string")).count() == 1
    ids = spark.range(5).withColumnRenamed("id", "problem_idx")
    assert readers.selected_problems(ids, [1, 9]).count() == 1 and readers.selected_problems(ids, []).count() == 0 and readers.selected_problems(ids, limit=2).count() == 2
    (tmp_path / "run.json").write_text('{"dataset": {"data_path": "d.parquet"}}')
    assert readers.dataset_path(str(tmp_path / "run.json")) == "d.parquet"


def test_small_expressions(spark):
    row = spark.range(1).select(
        X.two_decimals(F.lit(2.345678)), X.percent(F.lit(0.1234)), X.thousands(F.lit(1234567)), X.undoubled(F.lit("{{a}}")), X.says_yes(F.lit("Oh YES")), X.safe_int(F.lit("x")), prepare.word_count(F.lit(" a b c ")), prepare.word_count(F.lit(None)),
    ).first()
    assert tuple(row) == ("2.35", "12.3%", "1,234,567", "{a}", True, None, 3, 0)
    turns = spark.range(1).select(P.chat_payload(F.lit("s"), F.lit("q"), F.lit("more"), single=True), P.chat_payload(F.lit("s"), F.lit("q"), F.lit(None).cast("array<string>"))).first()
    assert [[m["content"] for m in t] for t in turns] == [["s", "q", "more"], ["s", "q"]]
    assert spark.range(1).select(P.hint_request(F.lit("Q"), F.lit("S"))).first()[0].startswith("Question:\nQ\n\nSolution:\nS\n\n")


def test_runs():
    assert runs.run_folder("r", "7") == "r/7" and runs.run_folder("r", "7", "e") == "r/e/runs/7" and runs.retry_path("d/x.jsonl") == "d/x_retry.jsonl" and runs.sibling("d/x", "y") == "d/y"
    config = {"model": {"name": "m"}, "k": 1}
    assert runs.overridden(config, {"model.name": "n", "k": None, "new.at": 2}) == {"model": {"name": "n"}, "k": 1, "new": {"at": 2}}
    assert runs.capped(config, 9)["generation"] == {"max_tokens": 9} and config == {"model": {"name": "m"}, "k": 1}
    with pytest.raises(ValueError, match="id"):
        runs.run_folder("r", "")


def test_checkpoint_tables(spark):
    good = {"custom_id": "1", "response": {"status_code": 200, "body": {"output_text": json.dumps({"concise_hint": "c", "detailed_method_hint": ["m"], "detailed_scaffold_hint": "s"}), "usage": {"input_tokens": 5}}}}
    lines = spark.createDataFrame([(0, json.dumps(good)), (1, '{"custom_id": "2"}')], "_pos long, v string").select("_pos", F.parse_json("v").alias("_v"))
    log = checkpoints.parse_results(lines, "_pos")
    assert checkpoints.table(log).columns == ["index", *checkpoints.FIELDS, "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens"] and checkpoints.table(log).count() == 1
    bad = checkpoints.parse_errors(spark.createDataFrame([('{"custom_id": "3", "error": {"code": 1}}',), ('{"custom_id": "4", "x": 1}',)], "v string").select(F.parse_json("v").alias("_v")))
    assert [tuple(r)[:3] for r in bad.orderBy("index").collect()] == [("3", "error", '{"code":1}'), ("4", "error", '{"custom_id":"4","x":1}')]
    assert log.drop("_pos").unionByName(bad).count() == 4


def rows(spark):
    data = [(i, str(i), "ds" if i % 3 else None, "q", str(i), rf"<think>{'long ' * 20}</think>\boxed{{{i if i % 4 else 'no'}}}" if i % 5 else "none", "stop" if i % 6 else "length", 100 + i) for i in range(60)]
    return spark.createDataFrame(data, "_pos long, index string, dataset string, question string, label string, model_output string, finish_reason string, output_token_length long")


def test_reports(spark):
    graded = grade.grade(rows(spark))
    text = reports.metrics(graded)
    assert "| ds | 40 |" in text and "| unknown | 20 |" in text and "## think_type" in text
    judged = graded.withColumn("reason", F.when(F.col("_pos") == 4, "odd").otherwise(F.col("reason")))
    text = reports.negative(judged)
    assert "of 60 rows are incorrect" in text and "| odd | think_type | reasoning_think | 1 |" in text and "| 0 | none |" in text
    tokens = spark.createDataFrame([(str(i), 50.0) for i in range(50)], "index string, train_token double")
    text = reports.positive(graded, rows(spark).where("_pos <> 7"), tokens)
    assert "| >=2.0 |" in text and "lack a generation or a train token, such as 7, 51," in text
    cases = [r["text"] for r in reports.incorrect_cases(graded).collect()]
    assert len(cases) == graded.where("is_correct = 0").count() and all("\n### " in c for c in cases)
    assert [c.split("\n")[1] for c in cases if "\n## " in c] == ["## ds", "## unknown"] and cases[0].startswith("\n## ds\n\n### 1: ")
    assert reports.incorrect_cases(graded.limit(0)).count() == 0
    full = analyze.enriched(graded.drop("model_output", "question"), rows(spark))
    assert full.where("_is_correct and model_output = '' or predict is null").count() == 0


def test_outputs_are_joined_to_inputs(spark):
    ins = rows(spark).drop("model_output", "finish_reason", "output_token_length")
    out = prepare.assembled(ins, rows(spark).select("_pos", "model_output", "finish_reason"), "r1")
    assert out.count() == 60 and out.where("_pos = 1").first()["output_token_length"] == 21
    with pytest.raises(Exception, match="no output at position 3"):
        prepare.assembled(ins, rows(spark).where("_pos <> 3"), "r1").collect()
    assert tuple(prepare.length_counts(rows(spark)).first()) == (60, 50, 10)
    assert [r["index"] for r in prepare.pending(rows(spark), rows(spark).where("_pos < 5"), 3).collect()] == ["5", "6", "7"]
    assert [r["_pos"] for r in prepare.preview(rows(spark), 2).collect()] == [0, 1]


def test_writers(spark, tmp_path):
    writers.write_keys(rows(spark), str(tmp_path / "keys"))
    assert [r["index"] for r in readers.ordered_keys(spark, str(tmp_path / "keys")).orderBy("_pos").collect()] == [str(i) for i in range(60)]
    writers.write_json_lines(rows(spark), str(tmp_path / "rows"))
    writers.write_json_lines(rows(spark), str(tmp_path / "rows"), append=True)
    assert spark.read.json(str(tmp_path / "rows")).count() == 120
    writers.write_history(spark.createDataFrame([(1, 0.5)], "step int, loss double"), str(tmp_path / "h"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "h" / "csv")).columns) == writers.HISTORY
    writers.write_stats([{"a": 1}], str(tmp_path / "s.json"))
    writers.write_config({"a": "é"}, str(tmp_path / "c" / "c.yaml"))
    assert json.load(open(tmp_path / "s.json")) == [{"a": 1}] and "é" in (tmp_path / "c" / "c.yaml").read_text()
    writers.write_sft(spark.createDataFrame([(0, "i", "o", ""), (1, "i2", "o2", "7")], "_pos long, instruction string, output string, index string"), str(tmp_path / "sft.json"))
    assert json.load(open(tmp_path / "sft.json")) == [{"instruction": "i", "output": "o"}, {"instruction": "i2", "output": "o2", "index": "7"}]
    requests = writers.batch_requests(rows(spark), F.struct("question"), size=25).collect()
    assert sorted({r["chunk"] for r in requests}) == [0, 1, 2] and json.loads(requests[0]["request"])["method"] == "POST"


def test_one_file_of_many_tasks(spark, tmp_path):
    path = tmp_path / "sub" / "all.txt"
    texts = spark.range(1000).repartition(7).orderBy("id").select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    for _ in range(2):
        write_one_file(texts, str(path), begin="[", between=",", end="]")
        assert path.read_text() == "[" + ",".join(f"é{i}" for i in range(1000)) + "]"
    write_one_file(texts.limit(0), str(path), begin="[", end="]", empty="none")
    assert path.read_text() == "[none]"
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="broken"):
        write_one_file(broken, str(path))
    assert path.read_text() == "[none]" and [p.name for p in path.parent.iterdir()] == ["all.txt"]


def test_positions_read_the_data_once(spark, tmp_path):
    """Row groups, splits and filters don't move positions; the plan has one scan of the columns, the other reads none."""
    spark.range(0, 30_000, 1, 3).withColumn("pad", F.md5(F.col("id").cast("string"))).write.option("parquet.block.size", 65536).parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = readers.positioned(spark.read.parquet(str(tmp_path / "t")))
        assert df.rdd.getNumPartitions() > 3
        assert df.where("_pos <> id").count() == 0 and df.where("id % 7 = 0").count() == 4286
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("ReadSchema: struct<id:bigint,pad:string,_tmp_metadata_row_index:bigint>") == 1
        assert plan.count("ReadSchema: struct<_tmp_metadata_row_index:bigint>") == 1 and plan.count("ReadSchema") == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chunks_of_ties(spark, tmp_path):
    rows = spark.range(0, 95, 1, 4).withColumn("tie", F.lit(1)).withColumn("_x", F.lit(0))
    names = writers.write_chunks(rows, str(tmp_path), "c", order="tie", size=10)
    ids = [r["id"] for n in names for r in json.load(open(n))]
    assert len(names) == 10 and sorted(ids) == list(range(95)) and names[-1].endswith("c_part10_of10_rows91-95.json")


def test_command_lines(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    run = lambda *argv: cli.main(list(map(str, argv)), spark)
    writers.write_json_lines(rows(spark), at("outputs.jsonl"))
    data = rows(spark).select("_pos", "index", "question", F.concat(F.lit("s "), F.repeat(F.lit(r"\boxed{1}"), (F.col("_pos") % 3).cast("int"))).alias("solution"), F.col("label").alias("final_answer"), F.lit(80.0).alias("train_token"), F.lit("ds").alias("dataset"))
    data.drop("_pos").coalesce(1).write.parquet(at("data.parquet"))
    data.select("index", F.lit("h").alias("detailed_method_hint")).write.parquet(at("hints.parquet"))
    (tmp_path / "invalid.txt").write_text("3\n900\n")
    run("subset", "--input", at("data.parquet"), "--sample-size", 10, "--hints", at("hints.parquet"))
    assert spark.read.parquet(at("data_sub10_seed9.parquet")).count() == spark.read.parquet(at("hints_sub10_seed9.parquet")).count() == 10
    run("key-overlap", "--left", at("data.parquet"), "--right", at("hints_sub10_seed9.parquet"))
    run("review-export", "--input", at("data.parquet"), "--hints", at("hints.parquet"), "--output-root", at("review"), "--chunk-size", 25)
    assert len(list((tmp_path / "review").glob("*.json"))) == 3
    run("multi-box-count", "--input", at("data.parquet"), "--examples", 2)
    run("filter", "--input", at("data.parquet"), "--invalid", at("invalid.txt"), "--output", at("filtered.parquet"), "--hints", at("hints.parquet"), "--stats-output", at("stats.json"))
    assert json.load(open(at("stats.json"))) == [{"original": 60, "invalid_in_file": 2, "invalid_matched": 1, "after_invalid": 59, "multi_box": 20, "after_multi_box": 39, "hints": 39}]
    run("inputs", "--input", at("data.parquet"), "--hints", at("hints.parquet"), "--condition", "detailmethod", "--output", at("inputs.parquet"))
    assert "Hint: h" in spark.read.parquet(at("inputs.parquet")).first()["input_text"]
    run("assemble", "--inputs", at("data.parquet"), "--outputs", at("outputs.jsonl"), "--run-id", "r", "--output", at("gens.jsonl"), "--retry-output", at("retry.jsonl"))
    assert spark.read.json(at("gens.jsonl")).count() == 50 and spark.read.json(at("retry.jsonl")).count() == 10
    run("grade", "--input", at("outputs.jsonl"), "--output", at("graded.jsonl"))
    run("negative", "--prediction", at("graded.jsonl"), "--output", at("negative.md"))
    run("positive", "--prediction", at("graded.jsonl"), "--generations", at("outputs.jsonl"), "--dataset", at("data.parquet"), "--output", at("positive.md"))
    run("metrics", "--prediction", at("graded.jsonl"), "--generations", at("outputs.jsonl"), "--metrics-output", at("metrics.md"), "--incorrect-output", at("cases.md"))
    assert all((tmp_path / f).stat().st_size > 100 for f in ("negative.md", "positive.md", "metrics.md", "cases.md"))
    run("suspects", "--prediction", at("graded.jsonl"), "--generations", at("outputs.jsonl"), "--output-dir", at("suspects"))
    assert len(json.load(open(next((tmp_path / "suspects").glob("*.json"))))) == spark.read.json(at("graded.jsonl")).where("is_correct = 0").count()
    n = spark.read.json(at("graded.jsonl")).where("is_correct = 0").count()
    ok = spark.read.json(at("graded.jsonl")).where("is_correct = 1")
    fast = [ok.where(f"output_token_length / 80 >= {a} and output_token_length / 80 < {b}").count() for a, b in ((1.2, 9), (1.0, 1.2), (0.8, 1.0))]
    size = n + fast[0] + fast[1] // 2 + fast[2] // 2
    run("curriculum", "--prediction", at("graded.jsonl"), "--dataset", at("data.parquet"), "--output-dir", at("cur"), "--target-hard-size", size)
    assert readers.ordered_keys(spark, at("cur/hard")).count() == size and json.load(open(at("cur/stats.json")))["check"]["target_met"]
    spark.read.json(at("graded.jsonl")).write.parquet(at("graded.parquet"))
    spark.read.json(at("graded.jsonl")).where("is_correct = 0").write.parquet(at("suspects.parquet"))
    (tmp_path / "yes.txt").write_text("0\n4\n")
    run("judgement", "--prediction", at("graded.parquet"), "--false-negative", at("yes.txt"), "--suspect-false-negative", at("suspects.parquet"))
    assert spark.read.parquet(at("graded.parquet")).where("reason = 'llm_judge'").count() == 2 and spark.read.parquet(at("suspects.parquet")).count() == n - 2
    run("sft-records", "--input", at("data.parquet"), "--output", at("sft.json"), "--limit", 5)
    assert len(json.load(open(at("sft.json")))) == 5
    good = {"custom_id": "1", "response": {"status_code": 200, "body": {"output_text": json.dumps({"concise_hint": "c", "detailed_method_hint": ["m"], "detailed_scaffold_hint": ["s"]})}}}
    (tmp_path / "res.jsonl").write_text(json.dumps(good) + "\n")
    (tmp_path / "err.jsonl").write_text('{"custom_id": "2", "error": "x"}\n')
    (tmp_path / "job.json").write_text(json.dumps({"job_type": "hint-results", "results": at("res.jsonl"), "errors": at("err.jsonl"), "output": at("never")}))
    run("run", "--config", at("job.json"), "--set", f"output={at('table.parquet')}")
    assert [r["index"] for r in spark.read.parquet(at("table.parquet")).collect()] == ["1"]
    capsys.readouterr()
