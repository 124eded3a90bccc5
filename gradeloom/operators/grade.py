"""Grading of outputs. Boxes and thoughts are found natively; the matcher sees a row's label and box alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gradeloom.functions import boxes as B
from gradeloom.functions import exprs as X
from gradeloom.functions import matcher as M


@F.pandas_udf(StringType())
def _reason(label: pd.Series, box: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else M.match_box(a, b) for a, b in zip(label, box, strict=True)], dtype=object)


def grade(df: DataFrame) -> DataFrame:
    """Adds is_correct, reason, extracted_answer, last_box_source and think_type to rows with label and model_output.

    An output without a balanced box can't be extracted. Each of the columns costs nothing where it isn't asked for; only is_correct and reason need the matcher.
    """
    text = X.to_text(F.col("model_output"))
    rows = df.withColumn("label", X.to_text(F.col("label"))).withColumn("__box", B.last_box(text))
    box = F.col("__box.content")
    # the optimizer would put the folds into the call's arguments, where a Python function can't have them; it leaves a column alone that depends on a row's number
    rows = rows.withColumn("__content", F.when(F.monotonically_increasing_id() >= 0, box))
    rows = rows.withColumn("reason", F.coalesce(_reason(F.col("label"), F.col("__content")), F.lit("can_not_extract")))
    added = {
        "is_correct": (~F.col("reason").isin("no_match", "can_not_extract")).cast("int"), "reason": F.col("reason"), "extracted_answer": F.when(F.col("__box").isNull(), X.clean_text(text)).otherwise(box),
        "last_box_source": B.box_source(text, F.col("__box.start")), "think_type": B.think_type(text),
    }
    return rows.select(*[F.col(c) for c in df.columns if c not in added], *[v.alias(k) for k, v in added.items()])


PREDICTION = ("run_id", "dataset", "index", "question", "model_output", "label", "extracted_answer", "is_correct", "reason", "output_token_length", "finish_reason", "last_box_source", "think_type")


def predictions(df: DataFrame) -> DataFrame:
    """Graded rows with the thirteen fields of a prediction; absent ones are null."""
    out = grade(df)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in PREDICTION])
