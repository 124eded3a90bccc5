"""Reports of the analyses as Markdown. All counting is Spark's; the driver lays out small tables and streams long ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X

from . import analyze

_TOKENS = ("n", "q1", "q2", "q3", "mean")


def _cell(v: object) -> str:
    return "-" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)


def table(df: DataFrame, *columns: str) -> Iterator[str]:
    """Rows of an ordered table, streamed."""
    yield f"| {' | '.join(columns)} |"
    yield f"|{'---|' * len(columns)}"
    for r in df.select(*columns).toLocalIterator():
        yield f"| {' | '.join(map(_cell, r))} |"


def _section(title: str, df: DataFrame, *columns: str) -> Iterator[str]:
    yield from ("", f"## {title}", "")
    yield from table(df, *columns)


def _by_finish(df: DataFrame, *first: str) -> DataFrame:
    """Rows with finish_reason as a label, and its rank."""
    out = df.withColumn("finish_reason", X.label(F.col("finish_reason")))
    return out.withColumn("finish_rank", X.finish_rank(F.col("finish_reason"), *first))


def metrics(df: DataFrame) -> str:
    """Accuracy and tokens by dataset, finish reasons, and think types and box sources by dataset."""
    total = analyze.benchmark(df).withColumn("wrong", F.when(F.col("total") > 0, 100.0 - F.col("accuracy"))).orderBy(F.col("dataset") == "<all>", "dataset")
    lines = ["# Metrics", *_section("Datasets", total, "dataset", "total", "correct", "accuracy", "incorrect", "wrong", "avg_tokens", "avg_tokens_correct", "avg_tokens_incorrect")]
    lines += _section("Finish reasons", analyze.finish_matrix(df).orderBy("dataset", "finish_rank", "finish_reason"), "dataset", "finish_reason", "n", "correct", "incorrect", "avg_tokens")
    for c in ("think_type", "last_box_source"):
        sums = df.groupBy(X.to_text(F.col("dataset"), "unknown").alias("dataset"), X.label(F.col(c)).alias(c)).agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first_pos"))
        lines += _section(c, sums.orderBy("dataset", F.desc("n"), "first_pos"), "dataset", c, "n")
    return "\n".join(lines) + "\n"


def negative(df: DataFrame) -> str:
    """Incorrect rows: their finish reasons, tokens, reasons with box sources and think types, and the indexes of those without a box source."""
    bad = _by_finish(analyze.flagged(df).where("_bad"), "length", "stop")
    at = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    lines = ["# Incorrect rows", "", f"{bad.count()} of {at} rows are incorrect."]
    lines += _section("Finish reasons", analyze.counter(bad, "finish_reason").orderBy("rank"), "value", "n")
    lines += _section("Output tokens", analyze.quantiles(bad, "output_token_length"), *_TOKENS)
    lines += _section("Output tokens by finish reason", analyze.quantiles(bad, "output_token_length", ["finish_rank", "finish_reason"]).orderBy("finish_rank", "finish_reason"), "finish_reason", *_TOKENS)
    four = ("finish_reason", "reason", "last_box_source", "think_type")
    lines += _section("Reasons", analyze.breakdown(df).orderBy("finish_rank", *four[:3], F.desc("n"), "first_pos"), *four, "n")
    lines += _section("Other reasons", analyze.other_reasons(df).orderBy("finish_reason", "reason", "kind", F.desc("n"), "first_pos"), "finish_reason", "reason", "kind", "value", "n")
    lines += _section("Without a box source", analyze.unboxed_indexes(df).orderBy("_pos"), "index", "last_box_source")
    return "\n".join(lines) + "\n"


def positive(predictions: DataFrame, generations: DataFrame, tokens: DataFrame, examples: int = 10) -> str:
    """Correct rows: their tokens overall and by finish reason, the ratio to train tokens, and what lacks a generation or a target."""
    ok = _by_finish(analyze.positives(predictions, generations, tokens), "length", "stop")
    lines = ["# Correct rows", "", f"{ok.count()} of {predictions.count()} rows are correct."]
    lines += _section("Finish reasons", analyze.counter(ok, "finish_reason").orderBy("rank"), "value", "n")
    lines += _section("Output tokens", analyze.quantiles(ok, "output_token_length"), *_TOKENS)
    lines += _section("Output tokens by finish reason", analyze.quantiles(ok, "output_token_length", ["finish_rank", "finish_reason"]).orderBy("finish_rank", "finish_reason"), "finish_reason", *_TOKENS)
    lines += _section("Ratio to train tokens", analyze.ratio_histogram(ok).orderBy("ratio_group"), "bucket", "n")
    for c in ("think_type", "last_box_source"):
        sums = ok.groupBy("finish_rank", "finish_reason", X.label(F.col(c)).alias(c)).agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first_pos"))
        lines += _section(c, sums.orderBy("finish_rank", "finish_reason", F.desc("n"), "first_pos"), "finish_reason", c, "n")
    lacking = ok.where("not has_generation or train_token is null")
    if n := lacking.count():
        some = [str(r["index"]) for r in lacking.orderBy("_pos").select("index").limit(examples).collect()]
        lines += ["", f"{n} correct rows lack a generation or a train token, such as {', '.join(some)}."]
    return "\n".join(lines) + "\n"


CASES = "# Incorrect cases\n"


def incorrect_cases(df: DataFrame) -> DataFrame:
    """Every incorrect row in full as ``text``, in order: by dataset, a heading before its first. For :func:`gradeloom.sources.one_file.write_one_file`, which heads it with CASES."""
    lines, blocks = ("label", "predict", "output_token_length", "finish_reason", "last_box_source", "think_type"), ("question", "model_output")
    value = lambda c: X.to_text(F.col(c)) if c in df.columns else F.lit("")
    rows = analyze.case_numbers(df.withColumn("dataset", X.to_text(F.col("dataset"), "unknown"))).orderBy("dataset", "case_number")
    head = F.when(F.col("case_number") == 1, F.concat(F.lit("\n## "), F.col("dataset"), F.lit("\n"))).otherwise(F.lit(""))
    parts = [head, F.lit("\n### "), F.col("case_number").cast("string"), F.lit(": "), value("index"), F.lit("\n")]
    for c in lines:
        parts += [F.lit(f"\n- {c}: "), value(c)]
    for c in blocks:
        parts += [F.lit(f"\n\n{c}:\n```text\n"), value(c), F.lit("\n```")]
    return rows.select(F.concat(*parts).alias("text"))
