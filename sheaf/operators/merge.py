"""Partial results of pages or chunks into one result, with conflicts kept until they are resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that name an item of a list, in order of preference.
KEYS = ("country", "region", "id", "name")


def candidates(value: Column, order: Column) -> Column:
    """Distinct non-null values of a group, in order of first appearance."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(rows, lambda x: x["v"]))


def scalars(partials: DataFrame, by: list[str], fields: list[str], order: str, texts: tuple[str, ...] = ()) -> DataFrame:
    """For each field its value, its candidates and whether they are in conflict: (value, candidates, is_conflict).

    One value wins, several are a conflict without a value. Without any a field of ``texts`` is empty, others are null.
    """
    out = partials.groupBy(*by).agg(*[candidates(F.col(f), F.col(order)).alias(f) for f in fields])
    one = lambda f: F.when(F.size(f) == 1, F.element_at(f, 1)).when((F.size(f) == 0) & F.lit(f in texts), F.lit("").cast(partials.schema[f].dataType) if f in texts else None)
    return out.select(*by, *[F.struct(one(f).alias("value"), F.col(f).alias("candidates"), (F.size(f) > 1).alias("is_conflict")).alias(f) for f in fields])


def in_conflict(merged: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(…, field, candidates as texts) of what is still to be resolved."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.is_conflict").alias("c"), F.col(f"{f}.candidates").cast("array<string>").alias("candidates")) for f in fields])
    return merged.select(*by, F.explode(F.filter(rows, lambda r: r["c"])).alias("r")).select(*by, "r.field", "r.candidates")


def settled(merged: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Each field with its value; of an unresolved conflict the first candidate."""
    return merged.select(*by, *[F.when(F.col(f"{f}.is_conflict"), F.try_element_at(f"{f}.candidates", F.lit(1))).otherwise(F.col(f"{f}.value")).alias(f) for f in fields])


def resolved(merged: DataFrame, answers: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Conflicts replaced by ``answers`` (…, field, value as text); only fields that are there are changed."""
    wide = answers.where(F.col("field").isin(*fields)).groupBy(*by).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    out = merged.join(wide, by, "left")
    new = lambda f: F.when(F.col(f"{f}.is_conflict"), F.coalesce(F.col(f"_{f}").try_cast(merged.schema[f].dataType["value"].dataType), F.try_element_at(f"{f}.candidates", F.lit(1)))).otherwise(F.col(f"{f}.value"))
    return out.select(*by, *[new(f).alias(f) for f in fields])


def by_majority(partials: DataFrame, by: list[str], field: str, order: str) -> DataFrame:
    """(…, field, value): the value of most pages, of equally frequent ones that of the lowest page, then the least: the rule that stands in for a model."""
    seen = partials.where(F.col(field).isNotNull()).groupBy(*by, field).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    top = seen.groupBy(*by).agg(F.min_by(field, F.struct(-F.col("n"), "o", field)).alias("value"))
    return top.select(*by, F.lit(field).alias("field"), F.col("value").cast("string").alias("value"))


def items(partials: DataFrame, by: list[str], item: str, order: str, fields: list[str], lists: tuple[str, ...] = (), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Items of all pages' lists, one row each: those with the same key are one, in order of first appearance (``place`` from 1).

    The key is the first of ``keys`` that the items have as a field, in lower case; an item without one stays alone. Of each other field the
    first value that isn't null wins, and fields of ``lists`` are joined.
    """
    rows = partials.select(*by, F.col(order).alias("_o"), F.posexplode(item).alias("_p", "_i"))
    key = next((k for k in keys if k in fields), None)
    at = F.struct("_o", "_p")
    own = F.lower(F.col(f"_i.{key}").cast("string")) if key else F.lit(None).cast("string")
    rows = rows.withColumn("_k", own).withColumn("_u", F.when(F.col("_k").isNull(), at))
    first = lambda f: F.min_by(F.col(f"_i.{f}"), F.when(F.col(f"_i.{f}").isNotNull(), at))
    whole = lambda f: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.coalesce(F.col(f"_i.{f}"), F.array()).alias("v")))), lambda x: x["v"]))
    merged = rows.groupBy(*by, "_k", "_u").agg(F.min(at).alias("_at"), *[(whole(f) if f in lists else first(f)).alias(f) for f in fields])
    packed = merged.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", *fields))).alias("all"))
    return packed.select(*by, F.posexplode("all").alias("at", "x")).select(*by, (F.col("at") + 1).alias("place"), *[F.col(f"x.{f}").alias(f) for f in fields])


def first_wins(chunks: DataFrame, by: list[str], order: str, scalars_: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """Of each scalar the first value that isn't null, lists one after the other; failed chunks are rows of nulls. Ties of order go to the least value."""
    one = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(order, f))).alias(f) for f in scalars_]
    many = [F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))), lambda x: x["v"])).alias(f) for f in lists]
    return chunks.groupBy(*by).agg(*one, *many)
