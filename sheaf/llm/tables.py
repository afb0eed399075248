"""Columns that the operators need, apart from all others that a table may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of the rows with an id; a null text is empty. Other columns are never read."""
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).where(F.col("id").isNotNull())


def with_same_columns(frame: DataFrame, like: DataFrame) -> DataFrame:
    return frame.select(*[frame[c] for c in like.columns])


def spare_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
