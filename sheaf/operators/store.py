"""Tables that are written once and reread, so that what made them runs once and losing an executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, a temporary one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="sheaf-docs-")
    return _local["dir"]


def written(df: DataFrame) -> DataFrame:
    path = f"{folder(df.sparkSession)}/docs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
