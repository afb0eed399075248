"""Whether a predicted value is the expected one, and whether a document supports it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import strip

KINDS = ("EXACT", "FUZZY", "SEMANTIC", "NUMERIC", "CUSTOM")
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*)?\.?([0-9]+(_[0-9]+)*)?([eE][+-]?[0-9]+)?$"
WORD = r"[\p{L}\p{N}_]+"


def number(c: Column) -> Column:
    """A text as a double, null where it is none; literals such as 1d, which a cast takes, are none."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(_NUMBER) & s.rlike("[0-9]"), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def canonical(c: Column) -> Column:
    """JSON of an object or array with sorted keys and no blanks, null for other texts."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(r"^[\[{]"), F.to_json(F.try_parse_json(s)))


def exact(a: Column, b: Column) -> Column:
    """Equal texts, blanks around them aside; two JSON objects or arrays are equal in any order of keys."""
    x, y = canonical(a), canonical(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(strip(a.cast("string")) == strip(b.cast("string")))


def same_value(a: object, b: object) -> bool:
    """Deep equality of JSON values: plain ones by value, objects over the keys of either, lists by place, else by text."""
    plain = (str, int, float, bool)
    if isinstance(a, plain) and isinstance(b, plain):
        return a == b
    if isinstance(a, dict) and isinstance(b, dict):
        return all(same_value(a.get(k), b.get(k)) for k in a.keys() | b.keys())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_value, a, b))
    return str(a) == str(b)


@F.pandas_udf(T.BooleanType())
def deep_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """``same_value`` of two columns of JSON; what isn't JSON is a text, null is null on both sides."""
    return pd.Series([same_value(_value(x), _value(y)) for x, y in zip(a, b, strict=True)], dtype="bool")


def _value(text: str | None) -> object:
    import json

    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def numeric(expected: Column, predicted: Column, tolerance: Column) -> Column:
    """Within a relative tolerance, an absolute one where nothing is expected; what isn't a number is compared exactly."""
    e, p = number(expected), number(predicted)
    close = F.when(e == 0, F.abs(p) <= tolerance).otherwise(F.abs(e - p) / F.abs(e) <= tolerance)
    return F.when(e.isNotNull() & p.isNotNull(), F.coalesce(close, F.lit(False))).otherwise(exact(expected, predicted))


def indel(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        if m := masks.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel`` of two columns, by bits of whole numbers."""
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy(a: Column, b: Column, least: Column) -> Column:
    return indel_ratio(strip(a.cast("string")), strip(b.cast("string"))) >= least


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in doubles; null if one is all zeros."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norms = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q)))
    return F.try_divide(dot, norms)


def matches(kind: Column, expected: Column, predicted: Column, threshold: Column, tolerance: Column, custom: Column | None = None, semantic: Column | None = None) -> Column:
    """By the kind of each row. Two nulls match, one null doesn't; an unknown kind is EXACT, SEMANTIC without a similarity FUZZY."""
    chosen = (
        F.when(kind == "NUMERIC", numeric(expected, predicted, tolerance))
        .when(kind == "FUZZY", fuzzy(expected, predicted, threshold))
        .when(kind == "SEMANTIC", F.coalesce(semantic >= threshold, fuzzy(expected, predicted, threshold)) if semantic is not None else fuzzy(expected, predicted, threshold))
    )
    if custom is not None:
        chosen = chosen.when(kind == "CUSTOM", custom)
    return F.when(expected.isNull() & predicted.isNull(), True).when(expected.isNull() | predicted.isNull(), False).otherwise(chosen.otherwise(exact(expected, predicted)))


def default_kind(field: T.DataType) -> str:
    return "NUMERIC" if isinstance(field, (T.IntegralType, T.FractionalType)) else "EXACT"


def unsupported(value: Column, document: Column) -> Column:
    """0 if the document holds the value, 0.3 if it holds its words, 0.6 if any 4 characters of it, else 0.9."""
    v, doc = F.lower(strip(value.cast("string"))), F.lower(document)
    words = F.regexp_extract_all(v, F.lit(WORD), F.lit(0))
    some = F.exists(F.sequence(F.lit(1), F.greatest(F.length(v) - 3, F.lit(1))), lambda i: F.contains(doc, F.substr(v, i, F.lit(4))))
    return (
        F.when(F.contains(doc, v), 0.0)
        .when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(doc, w)), 0.3)
        .when((F.length(v) > 3) & some, 0.6)
        .otherwise(0.9)
    )


def support_score(value: object, document: str) -> float:
    """``unsupported`` for any JSON value: lists of plain values and objects by the mean of their parts; 0 for an empty list, 0.5 for lists of others, empty objects and null."""
    import re

    if isinstance(value, list):
        if not value:
            return 0.0
        if not all(isinstance(x, (str, int, float, bool)) for x in value):
            return 0.5
        return sum(support_score(x, document) for x in value) / len(value)
    if isinstance(value, dict):
        return sum(support_score(x, document) for x in value.values()) / len(value) if value else 0.5
    if value is None:
        return 0.5
    v, doc = str(value).strip().lower(), document.lower()
    if v in doc:
        return 0.0
    words = re.findall(r"\w+", v)
    if words and all(w in doc for w in words):
        return 0.3
    return 0.6 if len(v) > 3 and any(v[i : i + 4] in doc for i in range(len(v) - 3)) else 0.9


@F.pandas_udf(T.DoubleType())
def nested_support(value: pd.Series, document: pd.Series) -> pd.Series:
    """``support_score`` of columns of JSON values and documents; for fields that aren't plain. A null value is null."""
    return pd.Series([None if v is None else support_score(_value(v), d or "") for v, d in zip(value, document, strict=True)], dtype="float64")


def support(value: Column, document: Column) -> Column:
    """By the sort of each value: objects and lists part by part in Python, others by built-in expressions."""
    nested = strip(value).rlike(r"^[\[{]")
    return F.when(nested, nested_support(F.when(nested, value), F.when(nested, document))).otherwise(unsupported(value, document))


def mean_or(values: Column, empty: float) -> Column:
    """Mean of an array, ``empty`` without values."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(empty))
