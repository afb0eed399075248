"""Contracts: the fields that a model is to fill, as Spark types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def contract(ddl: str) -> T.StructType:
    """A contract from DDL; text is never evaluated as code."""
    return relaxed(T.StructType.fromDDL(ddl))


def from_annotations(cls: type) -> T.StructType:
    """A contract from a class with annotated fields, inherited ones included; nested classes become structs."""
    import typing

    def of(t: object) -> T.DataType:
        origin, args = typing.get_origin(t), typing.get_args(t)
        if t in _TYPES:
            return _TYPES[t]
        if origin is list:
            return T.ArrayType(of(args[0]))
        if origin is dict:
            return T.MapType(of(args[0]), of(args[1]))
        if origin is typing.Literal:
            return T.StringType()
        some = [a for a in args if a is not type(None)]
        if args and len(some) == 1 and len(some) < len(args):
            return of(some[0])
        if isinstance(t, type) and typing.get_type_hints(t):
            return from_annotations(t)
        return T.VariantType()

    return T.StructType([T.StructField(n, of(t)) for n, t in typing.get_type_hints(cls).items()])


def relaxed(t: T.DataType) -> T.DataType:
    """The same type with every field optional, for results of single pages."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True, f.metadata) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(relaxed(t.elementType), True)
    return T.MapType(t.keyType, relaxed(t.valueType), True) if isinstance(t, T.MapType) else t


def rendered(t: T.StructType, indent: str = "") -> str:
    """The fields as lines, nested ones indented."""
    lines = []
    for f in t.fields:
        lines.append(f"{indent}{f.name} ({f.dataType.simpleString() if not isinstance(f.dataType, (T.StructType, T.ArrayType)) else f.dataType.typeName()}, {'optional' if f.nullable else 'required'})")
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.StructType):
            lines.append(rendered(inner, indent + "  "))
    return "\n".join(lines)


def read(raw: Column, fields: T.StructType) -> Column:
    """(parsed, valid) of JSON text: what doesn't fit is null and not valid; the row stays."""
    with_corrupt = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lambda x: F.from_json(x, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lambda x, p: F.struct(F.struct(*[p[f.name].alias(f.name) for f in fields.fields]).alias("parsed"), (x.isNotNull() & p["_corrupt"].isNull()).alias("valid"))
    # in arrays of one: as plain expressions text and JSON would be evaluated anew for each field
    return F.get(F.transform(F.array(raw), lambda x: F.get(F.transform(F.array(parsed(x)), lambda p: out(x, p)), F.lit(0))), F.lit(0))


def checked(df: DataFrame, required: list[str], allowed: dict[str, list] | None = None) -> DataFrame:
    """``df`` with schema_valid: required fields are there, and values are among those allowed."""
    ok = F.lit(True)
    for c in required:
        ok &= F.col(c).isNotNull()
    for c, values in (allowed or {}).items():
        ok &= F.col(c).isNull() | F.col(c).isin(*values)
    return df.withColumn("schema_valid", ok)
