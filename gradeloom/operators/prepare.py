"""Inference inputs, retries and training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.functions import prompts as P
from gradeloom.sources.readers import last_per_key, require_columns, require_keys, require_unique


def inference_inputs(df: DataFrame, hints: DataFrame | None = None, condition: str = "nohint", system: str | None = P.SYSTEM_PROMPT, hint_format: str = P.HINT_FORMAT, thinking: bool | None = None) -> DataFrame:
    """index, dataset, question, hint, label and input_text of each record.

    Question and index are the first of their names that isn't null, the index else the row's position (``_pos``, see readers.positioned); the label is the
    first of its names that is a column. A hint is looked up by the last row of its index, and is null without one.
    """
    cols = df.columns
    names = ["index", "id", "question_idx"]
    label = X.first_present(["answer", "final_answer", "label"], cols)
    if "_pos" in cols:
        pos = F.col("_pos").cast("string")
    else:
        pos = F.raise_error(F.lit("a record has no index; read positions with the table")).cast("string")
    question = F.coalesce(X.first_value(["question", "instruction", "prompt"], cols), F.raise_error(F.lit("a record has no question")).cast("string"))
    dataset = X.to_text(F.col("dataset"), "unknown") if "dataset" in cols else F.lit("unknown")
    out = df.select(F.coalesce(X.first_value(names, cols), pos).alias("index"), F.coalesce(X.first_value(names, cols), F.lit("")).alias("_key"), dataset.alias("dataset"), question.alias("question"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"))
    column = P.hint_column(condition)
    if column and hints is not None:
        require_columns(hints, "index", column)
        found = hints.select(X.key_text(F.col("index")).alias("_key"), F.col(column).alias("hint"), *(["_pos"] if "_pos" in hints.columns else []))
        out = out.join((last_per_key(found, "_key") if "_pos" in hints.columns else found).drop("_pos"), "_key", "left")
    else:
        out = out.withColumn("hint", F.lit(None).cast("string"))
    return out.drop("_key").withColumn("input_text", P.model_input(P.prompt_text(F.col("question"), F.col("hint"), hint_format), system, thinking))


def split_by_length(generations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, cut off by length); a null reason is kept."""
    cut = F.col("finish_reason").eqNullSafe(F.lit("length"))
    return generations.where(~cut), generations.where(cut)


def length_counts(generations: DataFrame) -> DataFrame:
    """Rows, rows kept, and rows cut off by length."""
    cut = F.col("finish_reason").eqNullSafe(F.lit("length"))
    return generations.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~cut).alias("kept"), F.count_if(cut).alias("cut"))


def assembled(inputs: DataFrame, outputs: DataFrame, run_id: str, key: str = "_pos") -> DataFrame:
    """Output rows with their input's fields, by position: run_id, dataset, index, question, label, hint, model_output, output_token_length, finish_reason. An input without its output is an error."""
    fields = [c for c in ("dataset", "index", "question", "label", "hint") if c in inputs.columns]
    got = outputs.select(key, "model_output", "finish_reason", F.col("output_token_length") if "output_token_length" in outputs.columns else word_count(F.col("model_output")).alias("output_token_length"), F.lit(True).alias("_there"))
    out = inputs.select(key, *fields).join(got, key, "left")
    there = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no output at position "), F.col(key).cast("string"))).cast(inputs.schema[key].dataType))
    return out.select(there.alias(key), F.lit(run_id).alias("run_id"), *fields, "model_output", "output_token_length", "finish_reason")


def _dataset_key(df: DataFrame) -> DataFrame:
    """A table can't tell a missing dataset from a null one, so that both are unknown."""
    return df.withColumns({"_ds": X.to_text(F.col("dataset"), "unknown") if "dataset" in df.columns else F.lit("unknown"), "_key": X.key_text(F.col("index"))})


def retry_records(source: DataFrame, cut: DataFrame, checked: bool = True) -> DataFrame:
    """Source rows whose (dataset, index) was cut off, in source order."""
    s, c = _dataset_key(source), _dataset_key(cut)
    if checked:
        require_unique(s, "_ds", "_key")
        require_unique(c, "_ds", "_key")
        if missing := c.join(s, ["_ds", "_key"], "left_anti").limit(10).collect():
            raise ValueError(f"retries without a source row: {[(r['_ds'], r['_key']) for r in missing]}")
    label = X.first_present(["answer", "final_answer", "label"], source.columns)
    return s.join(c.select("_ds", "_key"), ["_ds", "_key"], "left_semi").select(*[x for x in ("_pos",) if x in source.columns], F.col("_ds").alias("dataset"), "index", F.col(label).alias("label"), "question")


def retried(kept: DataFrame, again: DataFrame) -> DataFrame:
    return kept.unionByName(again, allowMissingColumns=True)


def sft_records(df: DataFrame) -> DataFrame:
    """instruction, output and index of rows whose cleaned question and solution are not empty."""
    require_columns(df, "question", "solution")
    thought = X.clean_text(F.col("thought")) if "thought" in df.columns else F.lit("")
    index = X.clean_text(F.col("index")) if "index" in df.columns else F.lit(None).cast("string")
    rows = df.select(*[c for c in ("_pos",) if c in df.columns], X.clean_text(F.col("question")).alias("_q"), X.clean_text(F.col("solution")).alias("_s"), thought.alias("_t"), index.alias("_i"))
    out = rows.where((F.length("_q") > 0) & (F.length("_s") > 0))
    return out.select(*[c for c in ("_pos",) if c in df.columns], F.col("_q").alias("instruction"), P.with_thought(F.col("_t"), F.col("_s")).alias("output"), F.nullif(F.col("_i"), F.lit("")).alias("index"))


def skipped(df: DataFrame) -> DataFrame:
    empty = (X.clean_text(F.col("question")) == "") | (X.clean_text(F.col("solution")) == "")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("skipped"))


def in_key_order(df: DataFrame, keys: DataFrame, checked: bool = True) -> DataFrame:
    """Rows of ``df`` by an ordered key list (index, _pos)."""
    if checked:
        require_unique(df, "index")
        require_keys(keys, df)
    return keys.join(df.drop("_pos").withColumn("index", X.key_text(F.col("index"))), "index")


def shuffled(df: DataFrame, seed: int, limit: int | None = None, key: str = "_pos") -> DataFrame:
    out = df.withColumn("_order", X.seeded(seed, F.col(key))).orderBy("_order", key)
    return out if limit is None else out.limit(limit)


def pending(df: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that aren't done; with a limit the first ones, by position, else by index."""
    left = df.withColumn("_key", X.key_text(F.col("index"))).join(done.select(X.key_text(F.col("index")).alias("_key")), "_key", "left_anti")
    if limit is not None:
        left = left.orderBy("_pos" if "_pos" in df.columns else "_key").limit(limit)
    return left.drop("_key")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first rows by position."""
    return df.orderBy("_pos").limit(n)


def word_count(c):
    """Words of a text as a stand-in for its tokens, where the tokenizer is a boundary; an empty text has none."""
    t = X.clean_text(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+")))


def token_stats(df: DataFrame, column: str = "n_tokens") -> DataFrame:
    c = F.col(column)
    return df.agg(F.max(c).alias("max_tokens"), F.min(c).alias("min_tokens"), F.avg(c).alias("mean_tokens"), F.sum(c).alias("sum_tokens"))
