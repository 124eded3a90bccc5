"""The driver's tables seen as the tables of the curation pipeline, over all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.sources.readers import parquet


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return parquet(spark, f"{sf}/{name}.parquet", columns or None)


def pick(by: int, *values: str | None):
    """doc_id modulo the number of values picks one."""
    out = F.lit(values[-1]).cast("string")
    for i, v in enumerate(values[:-1]):
        out = F.when(F.col("doc_id") % by == i, F.lit(v).cast("string")).otherwise(out)
    return out


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", "doc_id", "source", "n_chars")
    q = table(spark, sf, "labels", "doc_id", "quality")
    return d.join(q, "doc_id", "left").select(
        F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("index"), F.col("source").alias("dataset"), F.col("quality").cast("int").alias("is_correct"), F.col("n_chars").alias("output_token_length"),
        F.when(F.col("n_chars") > 4000, "length").when(F.col("n_chars") >= 150, "stop").alias("finish_reason"),
        pick(3, "no_match", "can_not_extract", "no_match").alias("reason"), pick(4, "solution", "thought", "none", None).alias("last_box_source"), pick(3, "short_think", "missing_think", "reasoning_think").alias("think_type"),
    )


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Train tokens of the documents that aren't Spanish; those of multiples of 41 are there without a value."""
    d = table(spark, sf, "documents", "doc_id", "lang")
    value = F.when(F.col("doc_id") % 41 == 0, F.lit(float("nan"))).otherwise((200 + F.col("doc_id") % 7 * 300).cast("double"))
    return d.where("lang <> 'es'").select(F.col("doc_id").cast("string").alias("index"), value.alias("train_token"))


def labelled(spark: SparkSession, sf: str, toxic: int) -> DataFrame:
    """Indexes of the documents that are labelled toxic or not."""
    return table(spark, sf, "labels", "doc_id", "toxic").where(F.col("toxic") == toxic).select(F.col("doc_id").cast("string").alias("index"))


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as questions, solutions and (of a third) thoughts."""
    d = table(spark, sf, "documents", "doc_id", "text", "source", "n_chars")
    boxes = F.concat("text", F.repeat(F.lit(r" \boxed{1}"), (F.col("doc_id") % 4).cast("int")), F.lit(" end"))
    return d.select(F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("index"), F.col("text").alias("question"), boxes.alias("solution"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("thought"), F.col("n_chars").cast("string").alias("final_answer"), F.col("n_chars").alias("total_token"), "source")


def hints(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", "doc_id", "lang")
    return d.select("lang", F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("index"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("use "), "lang")).otherwise(F.lit("")).alias("detailed_method_hint"))


#: Expected answers by doc_id modulo their number ({n}: the document's characters), how they are boxed, and the grade: one for each tier and form.
ANSWERS = (
    (r"{n}", r"{n}", "literal_match"),
    (r"{n}", r"{n}.0", "numeric_match"),
    (r"{n}", r"{n}7", "no_match"),
    (r"{n}\text{ cm}", r"{n}", "literal_match"),
    (r"x = {n}", r"$ {n} $", "literal_match"),
    (r"\frac{{n}}{2}", r"\dfrac{{n}}{2}", "literal_match"),
    (r"{n}\times10^{2}", r"{n}00", "numeric_match"),
    (r"(a+{n})(a+1)", r"aa+a+{n}a+{n}", "symbolic_match"),
    (r"x \in [{n},\infty)", r"[{n},\infty)", "literal_match"),
    (r"\{{n}\}", r"{n}", "literal_match"),
    (r"\left({n},1\right)", r"({n},\,1)", "literal_match"),
    (r"({n},1)", r"{n},1", "no_match"),
    (r"\begin{pmatrix}{n}\end{pmatrix}", r"\begin{bmatrix}{n}\end{bmatrix}", "literal_match"),
    (r"{n}", r"\boxed{{n}}", "literal_match"),
    (r"{n}^\circ", r"{n}°", "literal_match"),
    (r"{n}%", r"{n}", "numeric_match"),
    (r"bb-{n}=(b-1)(b+{n})", r"(b-1)(b+{n})", "literal_match"),
    (r"f(x)={n}x", r"{n}x", "literal_match"),
    (r"2a+{n}b", r"{n}b+2a", "symbolic_match"),
    (r"\frac{a^2-{n}^2}{a-{n}}", r"a+{n}", "symbolic_match"),
    (r"\sqrt{{n}}+\sqrt{{n}}", r"2\sqrt{{n}}", "symbolic_match"),
    (r"\sqrt{{n}+1}", r"\sqrt{{n}+2}", "no_match"),
    (r"y={n}x+1", r"0=2-2y+{n}x+{n}x", "symbolic_match"),
    (r"2^{{n}+1}", r"(2^{{n}})(2)", "symbolic_match"),
    (r"\sin^2(x+{n})+\cos^2(x+{n})", r"1", "symbolic_match"),
    (r"{n}\times10^{1000000000000}", r"{n}\times10^{999999999999}", "no_match"),
    (r"{n}", "{" * 600 + "{n}" + "}" * 600, "symbolic_match"),
    ("{" * 5000 + "{n}" + "}" * 5000, r"{n}", "no_match"),
)


def answer(column: int) -> Column:
    """A column of ANSWERS by doc_id, with the document's characters in it."""
    return F.replace(pick(len(ANSWERS), *[x[column] for x in ANSWERS]), F.lit("{n}"), F.col("n_chars").cast("string"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """label and model_output of every form of ANSWERS, after a whole text."""
    d = table(spark, sf, "documents", "doc_id", "text", "n_chars")
    return d.select(F.col("doc_id").cast("string").alias("index"), answer(0).alias("label"), F.concat(F.col("text"), F.lit(r"\boxed{"), answer(1), F.lit("}")).alias("model_output"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """label and model_output in six shapes, each with a known grade, around whole texts."""
    d = table(spark, sf, "documents", "doc_id", "source", "text", "n_chars")
    t, n, k = F.col("text"), F.col("n_chars").cast("string"), F.col("doc_id") % 6
    boxed = lambda x: F.concat(F.lit(r"\boxed{"), x, F.lit("}"))
    thought = F.concat(F.lit("<think>"), t, F.lit("</think>"))
    shape = (
        F.when(k == 0, F.concat(thought, boxed(n)))
        .when(k == 1, F.concat(F.lit("<think>short</think>"), boxed(F.concat(n, F.lit(".0")))))
        .when(k == 2, F.concat(F.lit("<think>"), t, boxed(F.concat(n, F.lit("7")))))
        .when(k == 3, thought)
        .when(k == 4, F.concat(t, boxed(F.concat(n, F.lit(r"\text{ cm}")))))
        .otherwise(F.concat(t, F.lit(r"\boxed{"), n))
    )
    return d.select(F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("index"), F.col("source").alias("dataset"), n.alias("label"), shape.alias("model_output"), X.to_text(F.col("text")).alias("question"))
