import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.functions import prompts as P
from gradeloom.operators import analyze, curate, curriculum, grade, judge, prepare
from gradeloom.sources import readers, writers
from gradeloom.streaming import checkpoints, followed


def one(df):
    return df.first().asDict()


def test_truth(spark):
    words = spark.createDataFrame([(x,) for x in ("1", " TRUE ", "0", "False", "yes", "", None)], "c string").select(X.is_correct(F.col("c"), "string"), X.is_incorrect(F.col("c"), "string")).collect()
    assert [tuple(r) for r in words] == [(True, False), (True, False), (False, True), (False, True), (False, False), (False, False), (False, False)]
    v = spark.createDataFrame([(x,) for x in ("true", "1", '"1"', "0", "1.0", "2", "null")], "c string").select(X.is_correct_json(F.parse_json("c"))).collect()
    assert [r[0] for r in v] == [True, True, True, False, False, False, False]
    assert one(spark.range(1).select(X.is_correct(F.lit(1.0), "double").alias("x"))) == {"x": False}


def test_ratio_groups(spark):
    df = spark.createDataFrame([(x,) for x in (0.49, 0.5, 0.8, 1.0, 1.2, 1.5, 2.0, -1.0, float("nan"), float("inf"), None)], "r double")
    assert [r[0] for r in df.select(X.ratio_group(F.col("r"))).collect()] == [1, 2, 3, 4, 5, 6, 7, 1, 1, 7, None]


def test_white_space_and_boxes(spark):
    r = one(spark.range(1).select(X.clean_text(F.lit("\u00a0 a b\u2003\n")).alias("t"), X.boxed_count(F.lit("\\boxed{1} \\boxed\u00a0{2} \\boxed x")).alias("n"), X.clean_text(F.lit(None)).alias("e")))
    assert r == {"t": "a b", "n": 2, "e": ""}


def test_quantiles(spark):
    df = spark.createDataFrame([("1",), ("2",), ("4",), ("10",), ("x",), (None,)], "v string")
    assert one(analyze.quantiles(df, "v")) == {"n": 4, "q1": 1.75, "q2": 3.0, "q3": 5.5, "mean": 4.25}
    assert one(analyze.quantiles(df.limit(0), "v"))["q2"] is None


def test_occurrence_join(spark):
    gens = spark.createDataFrame([("7", "A", 0), ("7", "B", 1), ("7", "A", 2)], "index string, dataset string, _pos long")
    for wanted, matched in (("AAA", [0, 2, 2]), ("BA", [1, 2]), ("CC", [0, 1]), ([None, "A"], [0, 2])):
        preds = spark.createDataFrame([("7", d, i) for i, d in enumerate(wanted)], "index string, dataset string, _pos long")
        assert [r["g_pos"] for r in analyze.occurrence_join(preds, gens).orderBy("p_pos").collect()] == matched


def test_sample_is_exact_and_stable(spark):
    df = spark.range(500).select(F.col("id").alias("index"))
    a = [r[0] for r in curate.sample(df, 40, 9).select("index").collect()]
    b = [r[0] for r in curate.sample(df.repartition(13), 40, 9).select("index").collect()]
    assert a == b and len(set(a)) == 40
    with pytest.raises(ValueError, match="cannot sample"):
        curate.sample(df, 501, 9)


def test_checks_fire(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "index string")
    with pytest.raises(ValueError, match="duplicate"):
        readers.require_unique(df, "index")
    with pytest.raises(ValueError, match="without a match"):
        readers.require_keys(df, df.where("index = 'a'"))
    with pytest.raises(ValueError, match="missing columns"):
        readers.require_columns(df, "question")
    with pytest.raises(ValueError, match="negative"):
        curate.limited(df, -1)
    with pytest.raises(ValueError, match="both"):
        curate.threshold(df, "index", None)
    with pytest.raises(ValueError, match="unknown hint"):
        P.hint_column("more")


def test_curriculum_is_a_partition(spark):
    rows = [(str(i), i % 3 != 0, 100 + i * 13 % 900) for i in range(300)]
    preds = spark.createDataFrame(rows, "index string, is_correct boolean, output_token_length long")
    toks = spark.createDataFrame([(str(i), 400.0 if i % 11 else float("nan")) for i in range(290)], "index string, train_token double")
    need = curriculum.ranked(curriculum.annotated(preds, toks), 9).groupBy("pool").count().collect()
    n = {r["pool"]: r["count"] for r in need}
    target = n["incorrect"] + sum(n.get(f"group_{g}", 0) for g in (5, 6, 7)) + n["group_4"] // 2 + n["group_3"] // 2 + 3
    out = curriculum.split(preds, toks, target, 9)
    assert one(curriculum.self_check(out, target)) == {"hard": target, "easy": 300 - target, "overlap": 0, "union": 300, "target_met": True}
    with pytest.raises(ValueError, match="over the target"):
        curriculum.split(preds, toks, 5, 9)
    with pytest.raises(ValueError, match="cannot fill"):
        curriculum.split(preds, toks, 300, 9)


def test_grading_paths_agree(spark):
    from test_matcher import plain_source, plain_think

    from gradeloom.functions import matcher as M

    texts = ["no box", "<think>" + "word " * 30 + "</think> none", "<think>a</think>", r"<think>x \boxed{4}", None, r"\boxed{4}", "a</think><think>b</think>"]
    df = spark.createDataFrame([(i, "4", t) for i, t in enumerate(texts)], "id int, label string, model_output string")
    for r in grade.grade(df).collect():
        t = texts[r["id"]] or ""
        assert (r["think_type"], r["last_box_source"], bool(r["is_correct"])) == (plain_think(t), plain_source(t), M.match_answer("4", t).matched), t


def test_judgement(spark):
    p = spark.createDataFrame([(1, 0, "no_match"), (2, 0, "no_match")], "index int, is_correct int, reason string")
    c = spark.createDataFrame([("2",), ("9",)], "index string")
    assert [tuple(r) for r in judge.apply_verdicts(p, c).orderBy("index").collect()] == [(1, 0, "no_match"), (2, 1, "llm_judge")]
    assert one(judge.verdict_counts(p, c)) == {"total": 2, "updated": 1, "missing": 1}


def messages(spark, rows):
    return spark.createDataFrame([(rows,)], "m array<struct<role:string,content:string,reasoning_content:string>>")


def test_chat_templates(spark):
    rows = [("system", "S", None), ("user", "U", None), ("assistant", "<think>\nr\n</think>\n\nA", None), ("user", "V", None), ("assistant", "B", "why")]
    df = messages(spark, rows)
    short = df.select(P.chat_concise(F.col("m"), True, False)).first()[0]
    begin = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"
    end = "<|im_end|>\n<|im_start|>user\nV<|im_end|>\n<|im_start|>assistant\n<think>\nwhy\n</think>\n\nB<|im_end|>\n"
    assert short == begin + "<think>\nr\n</think>\n\nA" + end + "<|im_start|>assistant\n<think>\n\n</think>\n\n"
    assert df.select(P.chat_full(F.col("m"))).first()[0] == begin + "A" + end
    tools = messages(spark, [("user", "U", None), ("tool", "1", None), ("tool", "2", None)]).select(P.chat_full(F.col("m"))).first()[0]
    assert tools == "<|im_start|>user\nU<|im_end|>\n<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n"


def test_preference_and_messages(spark):
    got = spark.range(1).select(*P.preference(F.lit("p"), F.lit("c"), F.lit("r"))).first()
    assert tuple(got) == ("<|im_start|>user\np<|im_end|>\n", "<|im_start|>assistant\nc<|im_end|>\n", "<|im_start|>assistant\nr<|im_end|>\n")
    m = spark.range(1).select(P.sft_messages(F.lit(""), F.lit("i"), F.lit("o"), "d")).first()[0]
    assert [(x["role"], x["content"]) for x in m] == [("system", "d"), ("user", "i"), ("assistant", "o")]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\ufeff{"index": 1, "answer": null}\n\n{"index": "2"}\n', encoding="utf-8")
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl")).select(readers.field("_v", "index"), readers.has_field("_v", "answer"), readers.field_or("_v", "answer", F.lit("x"))).collect()
    assert [tuple(r) for r in rows] == [("1", True, None), ("2", False, "x")]
    (tmp_path / "b.jsonl").write_text('{"index": 1}\n[1]\nbroken\n')
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl")).select(F.to_json("_v")).collect()
    (tmp_path / "keys.txt").write_text("b\n\n a \nc\n")
    assert [r["index"] for r in readers.ordered_keys(spark, str(tmp_path / "keys.txt")).orderBy("_pos").collect()] == ["b", "a", "c"]
    (tmp_path / "doc.json").write_text('{"items": [{"index": 5}, {"index": 6}]}')
    assert readers.index_column(spark, str(tmp_path / "doc.json")).count() == 2


def test_chunks_cover_all_rows_once(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("_pos"), F.col("id").alias("index"))
    files = writers.write_chunks(df, str(tmp_path), "part", size=10)
    assert [f.rsplit("/", 1)[1] for f in files] == ["part_part01_of03_rows01-10.json", "part_part02_of03_rows11-20.json", "part_part03_of03_rows21-25.json"]
    assert [r["index"] for f in files for r in json.load(open(f))] == list(range(25))
    assert writers.write_chunks(df.limit(0), str(tmp_path / "none"), "part") == []
    assert writers.subset_name("x/d.parquet", 12000, 9, "total_token", 1950.5) == "x/d_total_token_le1950p5_sub12k_seed9.parquet"


def test_swap_of_a_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    writers.swap(spark.read.parquet(path).where("id < 4"), path)
    assert spark.read.parquet(path).count() == 4


def test_stream_appends_and_restarts(spark, tmp_path):
    land, table, marks = (str(tmp_path / x) for x in ("land", "table", "marks"))
    (tmp_path / "land").mkdir()

    def put(name, *ids):
        body = {"output_text": json.dumps({"concise_hint": "c", "detailed_method_hint": ["m"], "detailed_scaffold_hint": ["s"]})}
        (tmp_path / "land" / name).write_text("".join(json.dumps({"custom_id": i, "response": {"status_code": 200, "body": body}}) + "\n" for i in ids) + "broken\n")

    put("1.jsonl", "a", "b")
    followed.follow(spark, land, table, marks).awaitTermination()
    put("2.jsonl", "c")
    followed.follow(spark, land, table, marks).awaitTermination()
    log = spark.read.parquet(table)
    assert sorted(r["index"] for r in log.collect()) == ["a", "b", "c"]
    assert checkpoints.latest(log.withColumn("_pos", F.lit(1))).count() == 3
    assert prepare.pending(spark.createDataFrame([("a",), ("z",)], "index string"), log).collect()[0]["index"] == "z"
