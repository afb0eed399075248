"""Budgets, tiles and scales as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_PAGE, MOST_CONTENT, LEAST_THINKING, MOST_THINKING, MOST_ANSWER = 1500, 120_000, 1_200, 64_000, 8_000


def content_tokens(pages: Column) -> Column:
    return F.when(pages > 0, F.least((pages * PER_PAGE).cast("long"), F.lit(MOST_CONTENT).cast("long")))


def thinking_tokens(pages: Column) -> Column:
    """A third of the tokens of the pages, within bounds; null without pages."""
    third = F.floor(pages * PER_PAGE / 3)
    return F.when(pages > 0, F.greatest(F.lit(LEAST_THINKING).cast("long"), F.least(third, F.lit(MOST_THINKING).cast("long"))))


def answer_tokens(limit: Column, thinking: Column, thinks: Column) -> Column:
    """A limit that is set, up to the most; else the thinking budget if the model thinks."""
    most = F.lit(MOST_ANSWER).cast("long")
    return F.when(limit.isNotNull(), F.least(limit.cast("long"), most)).when(thinks, thinking).otherwise(most)


def tiles(height: Column, tile: int = 1000) -> Column:
    """(top, bottom) of each tile of an image, from the top."""
    n = F.greatest(F.ceil(height / tile), F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * tile).alias("top"), F.least((i + 1) * tile, height.cast("long")).alias("bottom")))


def scaled(width: Column, height: Column, most: int) -> Column:
    """(width, height) of an image that is fitted into a square, whole pixels; smaller ones stay."""
    longest = F.greatest(width, height)
    fit = lambda x: F.when(longest > most, F.floor(x * (F.lit(float(most)) / longest))).otherwise(x.cast("long"))
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def column_width(length: Column) -> Column:
    return F.greatest(F.lit(20).cast("long"), F.least(F.lit(40).cast("long"), length.cast("long") * 4))
