"""The corpus pipeline: quality rules, near-duplicate removal, passage removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``; the last returns the packed pieces. Each begins by having the executors give
back what the stage before left in their heaps.

Rows without words (null, empty or blank texts) fail the base rules and go in the first stage. A null language or source is one of its own; a row with a
null id stays, is nobody's copy and loses no words; rows that repeat are judged each in the first stage, and one of them stays in the
second, that of the least id; ties of the seeded orders fall by id and text. Long texts are handled whole. Columns that the stages don't use are carried on, whatever
their names; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import common, mixing, near_join, packing, quality, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or leave their language's perplexity band go."""
    common.release_executors(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked at 0.8 or more, the one with the least id stays."""
    common.release_executors(spark)
    return near_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a window of 50 that an earlier document also has go; rows of which nothing is left go. n_chars follows the text."""
    common.release_executors(spark)
    out = substrings.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix takes it, whole."""
    common.release_executors(spark)
    taken = mixing.mix(docs, mixing.n_words(F.col("text")), F.array(F.col("source")), mixing.cycle_521, cut=False, keep=docs.columns, prefix="__gl_")
    return taken.where("__gl_copies > 0").withColumn("__gl_again", F.explode(F.array_repeat(F.lit(0), F.col("__gl_copies").cast("int")))).select(docs.columns)


#: Chunks that the packing stage remembers in a task: a quarter of the usual, as executors that ran the other stages have less memory left.
CACHED = 400_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release_executors(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=CACHED, keep=False)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixture", mixture), ("packing", packed)]

#: SQL can't express the perplexity bands and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
