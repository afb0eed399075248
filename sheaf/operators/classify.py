"""Classification: names to classes, votes of several models, cascades, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import strip
from sheaf.operators.sizes import small

CONSENSUS, HIGHER_ORDER, CONSENSUS_WITH_THRESHOLD = "consensus", "higher_order", "consensus_with_threshold"


def matched(answers: DataFrame, classes: DataFrame, name: str = "name", class_name: str = "class_name", place: str = "ord") -> DataFrame:
    """Each answer with the first class of its name, case and blanks aside; others get the status unmatched."""
    key = lambda c: F.lower(strip(c))
    first = classes.groupBy(key(F.col(class_name)).alias("class_key")).agg(F.min_by(class_name, place).alias("matched"), F.min(place).alias("class_ord"))
    out = answers.withColumn("class_key", key(F.col(name))).join(small(first), "class_key", "left").drop("class_key")
    return out.withColumn("status", F.when(F.col("matched").isNull(), "unmatched").otherwise("ok"))


def vote(votes: DataFrame, by: list[str], strategy: str, threshold: float | None = None) -> DataFrame:
    """One result a group of ``by``, from (model_ord, name, confidence) votes; without agreement there is no row.

    CONSENSUS takes the first answer if all names are the same; HIGHER_ORDER the most confident, the first of equals;
    CONSENSUS_WITH_THRESHOLD asks for agreement and for confidence in all votes.
    """
    if threshold is not None and not 1 <= threshold <= 10:
        raise ValueError("a threshold is a number from 1 to 10")
    answer = F.struct("name", "confidence")
    if strategy == HIGHER_ORDER:
        return votes.groupBy(*by).agg(F.max_by(answer, F.struct(F.col("confidence"), -F.col("model_ord"))).alias("a")).select(*by, "a.*")
    if strategy not in (CONSENSUS, CONSENSUS_WITH_THRESHOLD):
        raise ValueError(f"no such strategy: {strategy}")
    # min = max is the same as one distinct name, without expanding the rows for a distinct count
    agreed = (F.min("name") == F.max("name")) & (F.count("name") == F.count(F.lit(1)))
    if strategy == CONSENSUS_WITH_THRESHOLD:
        agreed &= F.coalesce(F.min("confidence") >= (9 if threshold is None else threshold), F.lit(False))
    return votes.groupBy(*by).agg(F.min_by(answer, "model_ord").alias("a"), agreed.alias("agreed")).where("agreed").select(*by, "a.*")


def cascade(votes: DataFrame, doc: str, strategy: str, threshold: float | None = None, layer: str = "layer") -> DataFrame:
    """(document, layer, name, confidence, status): the first layer whose vote succeeds; status unresolved if none does."""
    done = vote(votes, [doc, layer], strategy, threshold)
    first = done.groupBy(doc).agg(F.min_by(F.struct(layer, "name", "confidence"), layer).alias("a"))
    every = votes.select(doc).distinct()
    out = every.join(first, doc, "left")
    return out.select(doc, "a.*", F.when(F.col("a").isNull(), "unresolved").otherwise("ok").alias("status"))


def through_layers(docs: DataFrame, layers: list, doc: str, strategy: str, threshold: float | None, store) -> DataFrame:
    """As ``cascade``, but a layer's models are only asked about documents that no earlier layer resolved.

    ``layers`` are functions from documents to votes; ``store`` writes a frame and reads it back, so that no model is asked twice.
    """
    rest, out = docs, None
    for number, ask in enumerate(layers):
        won = store(vote(ask(rest), [doc], strategy, threshold).withColumn("layer", F.lit(number)))
        out = won if out is None else out.unionByName(won)
        rest = rest.join(won.select(doc), doc, "left_anti")
    return out


def best_class(scores: DataFrame, doc: str, name: str = "name", place: str = "class_ord") -> DataFrame:
    """(document, name, confidence) of the most confident class of each image, the first of equals; Unknown if none is above 0."""
    top = F.max_by(F.struct(F.col(name).alias("name"), "confidence"), F.struct(F.col("confidence"), -F.col(place)))
    found = scores.groupBy(doc).agg(top.alias("a"))
    good = F.coalesce(F.col("a.confidence") > 0, F.lit(False))
    return found.select(doc, F.when(good, F.col("a.name")).otherwise("Unknown").alias("name"), F.when(good, F.col("a.confidence")).otherwise(F.lit(1)).alias("confidence"))


def through_tree(answers: DataFrame, tree: DataFrame, doc: str, depth: int, threshold: float) -> DataFrame:
    """(document, uuid, level, status): from the root down, each level's answer must name a child of the node before, with confidence.

    ``answers`` has (document, level, uuid, confidence), ``tree`` (uuid, parent_uuid), roots with a null parent. ``depth`` is the
    tree's depth, so there are as many joins with this small table as it has levels.
    """
    if not 1 <= threshold <= 10:
        raise ValueError("a threshold is a number from 1 to 10")
    at = answers.select(doc).distinct().select(doc, F.lit(None).cast("string").alias("node"), F.lit(0).alias("level"), F.lit("ok").alias("status"))
    inner = tree.select(F.col("parent_uuid").alias("p")).where("p is not null").distinct().withColumn("has_children", F.lit(True))
    for k in range(1, depth + 1):
        a = answers.where(F.col("level") == k).select(doc, F.col("uuid").alias("said"), F.col("confidence").alias("sure"))
        t = tree.select(F.col("uuid").alias("said"), F.col("parent_uuid").alias("below"), F.lit(True).alias("known"))
        at = at.join(a, doc, "left").join(small(t), "said", "left").join(small(inner), F.col("node") == F.col("p"), "left")
        goes = (F.col("status") == "ok") & ((F.lit(k) == 1) | F.col("has_children").isNotNull())
        fits = F.col("known").isNotNull() & F.col("below").eqNullSafe(F.col("node"))
        status = F.when(~goes, F.col("status")).when(F.col("sure").isNull() | (F.col("sure") < threshold), "low_confidence").when(~fits, "unmatched").otherwise("ok")
        moved = goes & (status == "ok")
        at = at.select(doc, F.when(moved, F.col("said")).otherwise(F.col("node")).alias("node"), F.when(moved, F.lit(k)).otherwise(F.col("level")).alias("level"), status.alias("status"))
    return at.select(doc, F.col("node").alias("uuid"), "level", "status")


def confident(answers: DataFrame, threshold: float) -> DataFrame:
    return answers.withColumn("status", F.when(F.coalesce(F.col("confidence") >= threshold, F.lit(False)), "ok").otherwise("low_confidence"))


def supports_batches(model: Column, names: tuple[str, ...] = ("gpt-4", "gpt-3.5-turbo", "o1", "claude")) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(model), n))


def by_rules(text: Column, rules: list[tuple[str, str, int]], default: str = "other") -> tuple[Column, Column]:
    """(name, confidence) of the first rule, (pattern, name, confidence), that the text holds."""
    name, sure = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0))
    for pattern, label, confidence in rules:
        hit = text.rlike(pattern)
        name, sure = name.when(hit, label), sure.when(hit, confidence)
    return name.otherwise(default), sure.otherwise(1)


def first_of(frame: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(order)
    return frame.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
