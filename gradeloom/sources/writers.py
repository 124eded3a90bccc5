"""Writers."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.ranks import numbered
from gradeloom.sources.one_file import write_one_file


def size_label(n: int) -> str:
    return f"{n // 1000}k" if n % 1000 == 0 else str(n)


def subset_name(path: str, n: int, seed: int, column: str | None = None, most: float | None = None) -> str:
    """File name that tells a subset's parameters."""
    p = Path(path)
    bound = f"_{column}_le{f'{most:g}'.replace('.', 'p')}" if column is not None else ""
    return str(p.with_name(f"{p.stem}{bound}_sub{size_label(n)}_seed{seed}{p.suffix}"))


def _in_chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    part, total = F.expr(f"(_n - 1) div {size}") + 1, F.col("_of")
    return numbered(df, [order]).withColumns({"part": part, "parts": F.ceil(total / size).cast("long"), "row_from": (part - 1) * size + 1, "row_to": F.least(part * size, total)})


def chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``_n``, part, parts, row_from and row_to (from 1) of each row's chunk in ``order``; ties fall in any order, but a row is in one chunk alone."""
    return _in_chunks(df, order, size).drop("_of")


def write_chunks(df: DataFrame, directory: str, stem: str, order: str = "_pos", size: int = 1000, clear: bool = True) -> list[str]:
    """JSON arrays of ``size`` records in files that name part and rows, each written where its rows are, under a name of its own and then renamed. No rows, no
    files; ``clear`` removes earlier ones. Returns the names; columns whose names begin with an underscore are left out. File systems are those of ``pyarrow.fs``."""
    where = directory if "://" in directory else Path(directory).absolute().as_uri()
    fs, top = pafs.FileSystem.from_uri(where)
    fs.create_dir(top, recursive=True)
    if clear:
        pattern = re.compile(rf"{re.escape(stem)}_part\d+_of\d+_rows\d+-\d+\.json")
        for old in fs.get_file_info(pafs.FileSelector(top)):
            if pattern.fullmatch(old.base_name):
                fs.delete_file(old.path)
    rows = _in_chunks(df, order, size).withColumn("wide", F.length(F.col("_of").cast("string")))
    fields = [c for c in df.columns if not c.startswith("_")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, out_top = pafs.FileSystem.from_uri(where)

        def flush(part: int, first: int, parts: int, wide: int, held: list[dict]) -> pa.RecordBatch:
            name = f"{stem}_part{part:0{max(2, len(str(parts)))}d}_of{parts:02d}_rows{first:0{wide}d}-{first + len(held) - 1:0{wide}d}.json"
            temporary = f"{out_top}/.{name}.{uuid.uuid4().hex}"
            with out_fs.open_output_stream(temporary) as out:
                out.write(json.dumps(held, ensure_ascii=False, indent=2, default=str).encode())
            out_fs.move(temporary, f"{out_top}/{name}")
            return pa.RecordBatch.from_pydict({"part": [part], "name": [name]})

        at, held = None, []
        for b in batches:
            for r in b.to_pylist():
                here = r.pop("part"), r.pop("row_from"), r.pop("parts"), r.pop("wide")
                if held and here != at:
                    yield flush(*at, held)
                    held = []
                at = here
                r.pop("_n")
                held.append(r)
        if held:
            yield flush(*at, held)

    laid = rows.select("part", "row_from", "parts", "wide", "_n", *fields).repartition("part").sortWithinPartitions("part", "_n")
    names = laid.mapInArrow(write, "part long, name string").collect()  # a row for each file
    return [f"{directory}/{r['name']}" for r in sorted(names)]


def write_json_lines(df: DataFrame, path: str, append: bool = False, drop: Iterable[str] = ("_pos",)) -> None:
    df.drop(*drop).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_keys(df: DataFrame, path: str, order: str = "_pos", key: str = "index") -> None:
    """A key a line, in order over the files by name."""
    df.orderBy(order).select(F.col(key).cast("string")).write.mode("overwrite").text(path)


def write_stats(stats: object, path: str) -> None:
    Path(path).write_text(json.dumps(stats, ensure_ascii=False, indent=2), encoding="utf-8")


def swap(df: DataFrame, path: str) -> None:
    """Replaces a Parquet folder that ``df`` may read, on any of Hadoop's file systems: written beside it, then renamed."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = (f"{path.rstrip('/')}.{uuid.uuid4().hex}.{x}" for x in ("new", "old"))
    try:
        df.write.parquet(new)
        if fs.exists(where(path)):
            fs.rename(where(path), where(old))
        if not fs.rename(where(new), where(path)):
            fs.rename(where(old), where(path))
            raise OSError(f"cannot rename {new} to {path}")
    finally:
        for p in (new, old):
            fs.delete(where(p), True)


def sft_json(instruction: Column, output: Column, index: Column) -> Column:
    """A training record; the index is left out when null or empty."""
    return F.to_json(F.struct(instruction.alias("instruction"), output.alias("output"), F.nullif(index.cast("string"), F.lit("")).alias("index")))


def write_sft(df: DataFrame, path: str, order: str = "_pos") -> None:
    """Training records as one pretty JSON array, written by tasks; an empty index is left out."""
    record = F.struct(F.col("instruction"), F.col("output"), F.nullif(F.col("index").cast("string"), F.lit("")).alias("index"))
    texts = df.orderBy(order).select(F.concat(F.lit("  "), F.replace(F.to_json(record, {"pretty": "true"}), F.lit("\n"), F.lit("\n  "))).alias("text"))
    write_one_file(texts, path, begin="[\n", between=",\n", end="\n]\n")


def batch_request(key: Column, body: Column, url: str = "/v1/responses") -> Column:
    return F.to_json(F.struct(key.cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


def batch_requests(df: DataFrame, body: Column, size: int = 1000, key: str = "index", order: str = "_pos") -> DataFrame:
    """chunk (from 0) and request of each row, ``size`` rows a chunk in order."""
    return chunked(df, order, size).select((F.col("part") - 1).alias("chunk"), batch_request(F.col(key), body).alias("request"))


#: Fields of a row of the metric history (fixed values).
HISTORY = ("step", "epoch", "loss", "train_loss", "mean_token_accuracy", "learning_rate", "grad_norm", "num_tokens")


def write_history(df: DataFrame, path: str) -> None:
    """Appends metric rows as JSON lines and as CSV with a header, with the fields of HISTORY; what a row lacks is null, what it has besides is left out."""
    df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in HISTORY])
    df.write.mode("append").json(f"{path}/jsonl")
    df.write.mode("append").option("header", True).csv(f"{path}/csv")


def write_config(config: dict, path: str) -> None:
    try:
        import yaml

        text = yaml.safe_dump(config, allow_unicode=True, sort_keys=False)
    except ImportError:
        text = json.dumps(config, ensure_ascii=False, indent=2)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
