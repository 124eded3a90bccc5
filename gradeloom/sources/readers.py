"""Readers. Row positions (``_pos``) are made here, where the order of a file is known, and carried on."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X

#: Keys that may hold a document's rows (fixed values).
WRAPPERS = ("data", "rows", "items", "records")
#: File parts that :func:`positioned` broadcasts at most.
MOST_PARTS = 1_000_000


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet table; with ``columns`` only these are read."""
    df = spark.read.parquet(path)
    return require_columns(df, *columns).select(*columns) if columns else df


def _places(df: DataFrame) -> DataFrame:
    """A file scan with its file, its place in the file, and an id that rises along each such part."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))


def _few_parts(df: DataFrame) -> bool:
    """Whether a table of the parts of these files can be broadcast: by their number and, if they can be split, their size. Nothing is read."""
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return len(df.inputFiles()) + size // split <= MOST_PARTS


def _numbered(scan: DataFrame) -> DataFrame:
    """``_pos`` from 0 in the order of the file names and the rows within, of a scan that may have been filtered. Rows of a part are read one after
    another, so that their ids differ from their positions by one number for each part; rows are not shuffled."""
    parts = scan.groupBy("__file", "__block").agg(F.min("__id").alias("low"), (F.max("__id") - F.min("__id") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select("__file", "__block", (before - F.col("low")).alias("__shift"))
    if _few_parts(scan):
        shift = F.broadcast(shift)
    out = scan.join(shift, ["__file", "__block"]).withColumn("_pos", F.col("__id") + F.col("__shift"))
    return out.drop("__file", "__block", "__id", "__shift")


def positioned(df: DataFrame) -> DataFrame:
    """Adds ``_pos``, from 0, to a table just read from files: its rows' order, files by name.

    Parquet knows each row's place in its file, so that only the files' row counts are added up; these come from a scan without columns, which reads footers. The data are read once.
    Other formats are read once for counts and once for rows.
    """
    files = df.inputFiles()
    if not files or not all(f.endswith(".parquet") for f in files):
        return _numbered(_places(df))
    place = F.col("_metadata.row_index")
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), place.alias("__row"))
    counts = df.select(F.col("_metadata.file_path").alias("__file"), place.alias("__row")).groupBy("__file").agg((F.max("__row") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("__file", before.alias("__shift"))
    if len(files) <= MOST_PARTS:
        shift = F.broadcast(shift)
    return rows.join(shift, "__file").withColumn("_pos", F.col("__row") + F.col("__shift")).drop("__file", "__row", "__shift")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, trimmed, with what :func:`_numbered` takes. The ids are made after blank lines are gone."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    kept = text.withColumn("value", X.clean_text(F.regexp_replace("value", "^\ufeff", ""))).where("value <> ''")
    return kept.withColumn("__id", F.monotonically_increasing_id())


def json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``_pos`` (from 0, blank lines left out) and ``_v`` (variant) of each line. Strict: a line that isn't a JSON object fails the job, naming
    path and position; lenient: it is left out. A byte order mark is accepted."""
    lines = _numbered(_lines(spark, path).withColumn("_path", F.col("__file")))
    v = F.try_parse_json("value")
    good = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    if not strict:
        return lines.where(good).select("_pos", v.alias("_v"))
    fail = F.raise_error(F.concat(F.lit("not a JSON object: "), "_path", F.lit(" row "), F.col("_pos").cast("string")))
    return lines.select("_pos", F.when(good, v).otherwise(fail.cast("variant")).alias("_v"))


def field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def has_field(v: Column, name: str) -> Column:
    """Whether the key is there, null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.to_json(v)), name), F.lit(False))


def field_or(v: Column, name: str, default: Column) -> Column:
    """The value if the key is there (also when it is null), else the default."""
    return F.when(has_field(v, name), field(v, name)).otherwise(default)


def json_document(spark: SparkSession, path: str, wrapped: bool = True) -> DataFrame:
    """Rows of a JSON document: a list, or (``wrapped``) a list under one of the wrapper keys, or one object. Without ``wrapped`` a document that is no list is an error."""
    if not wrapped:
        first = F.substring(X.clean_text(F.regexp_replace("value", "^\ufeff", "")), 1, 1)
        if spark.read.text(path, wholetext=True).where(first != "[").take(1):
            raise ValueError(f"{path} holds no JSON list")
    df = spark.read.json(path, multiLine=True)
    for w in WRAPPERS if wrapped else ():
        if w in df.columns and df.schema[w].dataType.typeName() == "array":
            return df.select(F.explode(w).alias("_r")).select("_r.*")
    return df


def records(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix."""
    kind = Path(path).suffix.lower()
    if kind == ".parquet":
        return positioned(spark.read.parquet(path))
    if kind in (".jsonl", ".json"):
        return positioned(json_document(spark, path, wrapped=False) if kind == ".json" else spark.read.json(path))
    raise ValueError(f"unsupported file type {kind!r}: use .json, .jsonl or .parquet")


def index_column(spark: SparkSession, path: str) -> DataFrame:
    kind = Path(path).suffix.lower()
    df = json_document(spark, path) if kind == ".json" else records(spark, path)
    return require_columns(df, "index").select(X.key_text(F.col("index")).alias("index"))


def key_set(spark: SparkSession, path: str, words_only: bool = False) -> DataFrame:
    """Distinct keys of a text file, a line each. With ``words_only`` white space within a key is an error and the file a .txt."""
    if words_only and Path(path).suffix.lower() != ".txt":
        raise ValueError("a key file must be a .txt file")
    keys = spark.read.text(path).select(X.clean_text(F.col("value")).alias("index")).where("index <> ''")
    if words_only:
        keys = keys.withColumn("index", F.when(F.col("index").rlike("[ \t]"), F.raise_error(F.lit("white space within a key"))).otherwise(F.col("index")))
    return keys.distinct()


def ordered_keys(spark: SparkSession, path: str) -> DataFrame:
    """index and ``_pos`` in file order; duplicates or an empty file are errors."""
    keys = _numbered(_lines(spark, path)).select(F.col("value").alias("index"), "_pos")
    if not keys.take(1):
        raise ValueError(f"no keys in {path}")
    require_unique(keys, "index")
    return keys


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*[X.key_text(F.col(k)).alias(k) for k in keys]).count().where("count > 1").orderBy(*keys).limit(5).collect()
    if twice:
        raise ValueError(f"duplicate keys, such as {[tuple(r)[:-1] for r in twice]}")
    return df


def require_keys(left: DataFrame, right: DataFrame, key: str = "index", most: int = 5) -> None:
    """Fails if a key of ``left`` is not in ``right``."""
    k = X.key_text(F.col(key)).alias("_key")
    missing = left.select(k).join(right.select(k), "_key", "left_anti").orderBy("_key").limit(most).collect()
    if missing:
        raise ValueError(f"keys without a match, such as {[r[0] for r in missing]}")


def last_per_key(df: DataFrame, key: str = "index", order: str = "_pos") -> DataFrame:
    """The last row of each key (null is a key), by one aggregation: the greatest (order, row) struct, combined map-side."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("_r")
    return df.groupBy(key).agg(F.max(order).alias(order), best).select(key, order, *[F.col(f"_r.{c}") for c in rest]).select(df.columns)


def train_tokens(df: DataFrame, checked: bool = True) -> DataFrame:
    """index and train_token as double, null as NaN: a row that is there without a value differs from no row. An index may be there once."""
    got = require_columns(df, "index", "train_token")
    if checked:
        require_unique(got, "index")
    return got.select(X.key_text(F.col("index")).alias("index"), F.coalesce(F.col("train_token").cast("double"), F.lit(float("nan"))).alias("train_token"))


def generations(df: DataFrame) -> DataFrame:
    """``df``, whose index must not be null."""
    index = F.coalesce(F.col("index").cast("string"), F.raise_error(F.lit("a generation has no index")).cast("string"))
    return require_columns(df, "index").withColumn("index", index)


def preference_triples(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """prompt, chosen and rejected as text; rows that lack one go."""
    got = require_columns(df, prompt, chosen, rejected)
    return got.select(*[F.col(c).cast("string").alias(n) for c, n in ((prompt, "prompt"), (chosen, "chosen"), (rejected, "rejected"))]).na.drop()


def selected_problems(df: DataFrame, idx: list | None = None, limit: int | None = None, column: str = "problem_idx") -> DataFrame:
    """Rows by a list of numbers (an empty list selects none), else the first ``limit`` by position, or by number where rows have none."""
    if idx is not None:
        return df.where(F.col(column).isin(idx)) if idx else df.limit(0)
    return df if limit is None else df.orderBy("_pos" if "_pos" in df.columns else column).limit(limit)


def config(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def dataset_path(run_config: str) -> str:
    """The dataset that a run's resolved config names."""
    found = config(run_config).get("dataset", {}).get("data_path")
    if not found:
        raise ValueError(f"{run_config} names no dataset.data_path")
    return found
