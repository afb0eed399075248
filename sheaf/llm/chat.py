"""Collapse of cumulative conversation snapshots, and chat rendering.

Logs often hold a conversation again and again as it grows. Every turn gets the rolling hash of all turns up to it; a
conversation whose last hash is an inner hash of another one is a snapshot of it. Anti-joins keep the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _plain(c: Column) -> Column:
    """Text that can't be mistaken for a marker: neither of its ends."""
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def prefixes(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, place, role, text, h1, h2, size): turns in order, with the rolling hash of all turns up to each.

    The hash is the exclusive or of two 64-bit hashes of (place, role, text), which is 128 bits in all.
    """
    t = turns.select(
        turns[conv_col].cast("long").alias("conv"),
        turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    )
    t = t.where("conv is not null").distinct()
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("place", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("conv")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n, salt in (("h1", 11), ("h2", 23)):
        t = t.withColumn(n, F.bit_xor(F.xxhash64(F.lit(salt), "place", "role", "text")).over(upto))
    return t.drop("turn")


def maximal(p: DataFrame) -> DataFrame:
    """Conversations that no longer one extends; of equal ones the least id."""
    whole = p.where("place = size").select("conv", "size", "h1", "h2")
    one = whole.groupBy("size", "h1", "h2").agg(F.min("conv").alias("conv"))
    inner = p.where("place < size").select(F.col("place").alias("size"), "h1", "h2").distinct()
    return one.join(inner, ["size", "h1", "h2"], "left_anti").select("conv")


def chat_texts(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(id, turns, chat) of the maximal conversations, rendered as <|role|> text <|end|> blocks.

    Turns are ordered by number, nulls first, then role and text; equal rows count once. A null role or text is empty, an empty role
    is rendered as user. Rows without a conversation id are left out. Markers within a text are broken by a space. Texts of any length
    are rendered whole. An empty table gives an empty result; other columns are not read.
    """
    p = prefixes(turns, conv_col)
    kept = p.select("conv", "place", "role", "text").join(maximal(p), "conv")
    block = F.concat(F.lit("<|"), F.when(F.col("role") == "", "user").otherwise(_plain(F.col("role"))), F.lit("|>\n"), _plain(F.col("text")), F.lit("<|end|>\n"))
    rows = kept.select("conv", "place", block.alias("block")).groupBy("conv").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("place", "block"))).alias("blocks"))
    return rows.select(F.col("conv").alias(conv_col), "turns", F.array_join("blocks.block", "").alias("chat"))
