"""Tables written to the folder that driver and executors share, where a plan is to be cut or run once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; in local mode without it, in a temporary folder of the application."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="gradeloom-"))
    path = f"{top.rstrip('/')}/gradeloom-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table that was written once: its lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
