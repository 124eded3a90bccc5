"""The boundary to generation: inputs in batches of exact size to a given function, each batch's answers saved when they are there.

A batch whose answers are saved isn't asked again, so that a run that failed, a lost executor or a repeated task costs only the batches that weren't finished. Batches are
cut by the inputs' order, which must be unique, so that a later run over the same inputs has the same batches. What a batch holds, the function decides: a model call, a service, a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradeloom.sources.one_file import located

from .ranks import numbered

BATCH = 512
#: What an answer holds besides its input (fixed names).
ANSWER = "model_output string, output_token_length long, finish_reason string"
#: Folders that the batches' files are spread over.
SPREAD = 1000


def _place(top: str, batch: int) -> str:
    return f"{top}/{batch % SPREAD:03d}/batch-{batch:010d}.parquet"


def generate(inputs: DataFrame, answer: Callable[[list[dict]], list[dict]], folder: str, batch_size: int = BATCH, order: str = "_pos", fields: str = ANSWER) -> DataFrame:
    """The inputs' rows with the fields of their answers, read from ``folder``, after all batches are there.

    ``answer`` takes a batch's rows and returns as many dictionaries of ``fields``; it runs in the executors. All batches have ``batch_size`` rows but the last.
    Batches are dealt by number; a task holds one at a time. The folder must belong to these inputs and this size alone. No inputs, no calls.
    """
    spark = inputs.sparkSession
    rows = numbered(inputs, [order]).withColumn("__batch", F.expr(f"(_n - 1) div {batch_size}"))
    schema = StructType([*inputs.schema.fields, *StructType.fromDDL(fields).fields])
    arrow, names = to_arrow_schema(schema), inputs.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = located(folder)

        def finish(number: int, held: list[dict]) -> pa.RecordBatch:
            path = _place(top, number)
            asked = fs.get_file_info(path).type != pafs.FileType.File
            if asked:
                got = answer(held)
                if len(got) != len(held):
                    raise ValueError(f"batch {number}: {len(got)} answers to {len(held)} inputs")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                temporary = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                pq.write_table(pa.Table.from_pylist([a | b for a, b in zip(held, got, strict=True)], schema=arrow), temporary, filesystem=fs)
                fs.move(temporary, path)
            return pa.RecordBatch.from_pydict({"rows": pa.array([len(held)], pa.int64()), "asked": pa.array([asked], pa.bool_())})

        at, held = None, []
        for b in batches:
            for r in b.to_pylist():
                number = r.pop("__batch")
                if held and number != at:
                    yield finish(at, held)
                    held = []
                at = number
                r.pop("_n")
                held.append(r)
        if held:
            yield finish(at, held)

    dealt = rows.select("__batch", "_n", *names).repartition("__batch").sortWithinPartitions("__batch", "_n")
    if not dealt.mapInArrow(ask, "rows long, asked boolean").agg(F.sum("rows")).first()[0]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
