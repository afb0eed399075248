"""Predictions against labels: comparisons in long form, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import similarity as S
from sheaf.operators.sizes import small

SKIPPED = ("doc_id", "metadata", "confidence")
CONTRADICTED = 0.7


def unlabelled(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Documents without labels."""
    return docs.join(labels.select(key), key, "left_anti")


def orphaned(labels: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Labels without documents."""
    return labels.join(docs.select(key), key, "left_anti")


def dataset(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return docs.join(labels, key)


def long_form(wide: DataFrame, key: str, fields: list[str], value: str) -> DataFrame:
    """(key, field, value) with values as texts, one row a field."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value)) for f in fields]))
    return wide.select(key, rows.alias("r")).select(key, "r.*")


def compared(expected: DataFrame, predicted: DataFrame, config: DataFrame, key: str, custom: Column | None = None, semantic: Column | None = None) -> DataFrame:
    """(key, field, expected, predicted, present, matched) of every expected field.

    ``config`` has (field, kind, threshold, tolerance); fields without a row are EXACT. A field that wasn't predicted is absent and wrong. ``custom`` and
    ``semantic`` are a verdict and a similarity over the columns expected and predicted, for the fields of these kinds.
    """
    p = predicted.select(key, "field", "predicted", F.lit(True).alias("there"))
    rows = expected.join(p, [key, "field"], "left").join(small(config), "field", "left")
    ok = S.matches(F.coalesce("kind", F.lit("EXACT")), F.col("expected"), F.col("predicted"), F.coalesce("threshold", F.lit(0.8)), F.coalesce("tolerance", F.lit(0.01)), custom, semantic)
    there = F.coalesce("there", F.lit(False))
    return rows.select(key, "field", "expected", "predicted", there.alias("present"), F.when(there, ok).otherwise(False).alias("matched"))


def key_union(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, field, expected, predicted, matched) over the fields of either side."""
    e, p = expected.select(key, "field", "expected"), predicted.select(key, "field", "predicted")
    return e.join(p, [key, "field"], "full").withColumn("matched", F.col("expected").eqNullSafe(F.col("predicted")))


def field_metrics(rows: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(field, total, tp, fp, fn, precision, recall, f1, accuracy). Wrong but present is a false positive only, absent a false negative only.

    With ``fields`` each of them has a row, zeros where nothing was seen.
    """
    out = rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("matched")).alias("tp"),
        F.count_if(~F.col("matched") & F.col("present")).alias("fp"),
        F.count_if(~F.col("matched") & ~F.col("present")).alias("fn"),
    )
    if fields is not None:
        out = small(fields.select("field")).join(out, "field", "left").fillna(0)
    p, r = _ratio("tp", F.col("tp") + F.col("fp")), _ratio("tp", F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", _ratio("tp", F.col("total")))


def _ratio(a: Column | str, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, b), F.lit(0.0))


def macro_metrics(metrics: DataFrame) -> DataFrame:
    """Means over all fields."""
    return metrics.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def document_accuracy(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """One row: (documents, accuracy), a document counting if all its fields match; one without fields does."""
    whole = rows.groupBy(key).agg(F.bool_and("matched").alias("whole"))
    return docs.select(key).join(whole, key, "left").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg(F.coalesce("whole", F.lit(True)).cast("double")), F.lit(0.0)).alias("accuracy"))


def schema_rate(docs: DataFrame, valid: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg(F.coalesce(valid, F.lit(False)).cast("double")), F.lit(0.0)).alias("schema_success_rate"))


def times(docs: DataFrame, seconds: str, failed: str) -> DataFrame:
    """(mean, least, most) seconds of the documents that didn't fail; zeros without any."""
    s = F.when(~F.col(failed), F.col(seconds))
    return docs.agg(*[F.coalesce(f(s), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean_s"), (F.min, "min_s"), (F.max, "max_s"))])


def priced(docs: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``docs`` with a cost, from (model, input_price, output_price) a token; an unknown model costs nothing."""
    out = docs.join(small(prices), model, "left")
    cost = F.coalesce(F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price"), F.lit(0.0))
    return out.withColumn("cost", cost).drop("input_price", "output_price")


def costs(docs: DataFrame) -> DataFrame:
    total = F.sum(F.col("input_tokens") + F.col("output_tokens"))
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.avg("cost"), F.lit(0.0)).alias("average_cost"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(total, F.lit(0)).alias("total_tokens"),
    )


def hallucinations(values: DataFrame, docs: DataFrame, key: str, text: str = "text", nested: bool = False) -> DataFrame:
    """(key, field, value, score) of the values that aren't null, by what the document's text holds; with ``nested`` values may be JSON objects and lists."""
    v = values.where(F.col("value").isNotNull() & ~F.col("field").isin(*SKIPPED))
    # values travel as one array a document, so a text is joined once, not once a field
    by_doc = v.groupBy(key).agg(F.collect_list(F.struct("field", "value")).alias("held"))
    rows = by_doc.join(docs.select(key, text), key).select(key, text, F.explode("held").alias("h"))
    return rows.select(key, "h.field", "h.value", (S.support if nested else S.unsupported)(F.col("h.value"), F.col(text)).alias("score"))


def hallucination_rate(scores: DataFrame, key: str) -> DataFrame:
    """(key, fields, overall): the share of contradicted fields."""
    return scores.groupBy(key).agg(F.count(F.lit(1)).alias("fields"), F.avg(F.when(F.col("score") >= CONTRADICTED, 1.0).otherwise(0.0)).alias("overall"))


def improvement(student: Column, teacher: Column) -> Column:
    """Of the teacher over the student in percent; from nothing it is infinite, or 0 for nothing again."""
    return F.when(student != 0, (teacher - student) / student * 100).when(teacher > 0, F.lit(float("inf"))).otherwise(0.0)


def teacher_student(teacher: DataFrame, student: DataFrame) -> DataFrame:
    """(field, student_accuracy, teacher_accuracy, improvement) from two tables of field metrics."""
    t = teacher.select("field", F.col("accuracy").alias("teacher_accuracy"))
    s = student.select("field", F.col("accuracy").alias("student_accuracy"))
    return s.join(t, "field").withColumn("improvement", improvement(F.col("student_accuracy"), F.col("teacher_accuracy")))


def report(name: str, **parts: DataFrame) -> DataFrame:
    """One row: (evaluation, report), the report being JSON of the one-row tables ``parts``."""
    out = None
    for part, frame in parts.items():
        one = frame.agg(F.first(F.struct(*frame.columns)).alias(part))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.lit(name).alias("evaluation"), F.to_json(F.struct(*parts)).alias("report"))


def printed(metrics: DataFrame) -> DataFrame:
    """(field, line): percentages as a reader sees them."""
    line = F.format_string("%s: precision %.2f%%, recall %.2f%%, f1 %.2f%%", F.col("field"), *[F.col(c) * 100 for c in ("precision", "recall", "f1")])
    return metrics.select("field", line.alias("line"))


def evaluated(docs: DataFrame, predicted: DataFrame, labels: DataFrame, fields: list[str], config: DataFrame, key: str, name: str, text: str = "content", custom: Column | None = None, semantic: Column | None = None) -> dict[str, DataFrame]:
    """All of an evaluation: rows, field_metrics, macro, documents, schema, hallucinations and the report.

    ``predicted`` and ``labels`` have (key, the fields); nested fields are compared as JSON. A document without a prediction counts as one of which nothing was found,
    and as not valid.
    """
    deep = any(predicted.schema[f].dataType.typeName() in ("struct", "array", "map") for f in fields)
    plain = lambda d: d.select(key, *[(F.to_json(f) if d.schema[f].dataType.typeName() in ("struct", "array", "map") else F.col(f).cast("string")).alias(f) for f in fields])
    e = long_form(plain(labels), key, fields, "expected").where("expected is not null")
    p = long_form(plain(predicted), key, fields, "predicted").where("predicted is not null")
    rows = compared(e, p, config, key, custom, semantic)
    metrics = field_metrics(rows, docs.sparkSession.createDataFrame([(f,) for f in fields], "field string"))
    judged = docs.join(labels.select(key), key, "left_semi").select(key, text)
    whole = document_accuracy(rows, judged, key)
    there = judged.select(key).join(predicted.select(key, F.lit(True).alias("valid")).distinct(), key, "left")
    schema_ = schema_rate(there, "valid")
    scores = hallucinations(p.withColumnRenamed("predicted", "value"), judged, key, text, deep)
    macro = macro_metrics(metrics)
    return {"rows": rows, "field_metrics": metrics, "macro": macro, "documents": whole, "schema": schema_, "hallucinations": hallucination_rate(scores, key), "report": report(name, macro=macro, documents=whole, schema=schema_)}
