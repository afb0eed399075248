"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sheaf.operators.prompts import batch_results


def write_batch(lines: DataFrame, path: str) -> None:
    """JSON lines of a batch."""
    lines.select("line").write.text(path)


def read_batch(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """All answers of a batch, parsed or not."""
    return batch_results(spark.read.text(path).withColumnRenamed("value", "line"), contract)


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)
