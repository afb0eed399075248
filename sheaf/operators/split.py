"""Page streams into sub-documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.pages import PAGE_BREAK, joined

GROUP = "array<struct<pages:array<int>,classification:string>>"


def verdicts(pages: DataFrame, same: Column, first: Column, second: Column, doc: str, page: str = "page_no") -> DataFrame:
    """(document, page, same, c1, c2) of each page and the next, from rules over ``now`` and ``after``, the two rows as structs.

    A null verdict counts as the same document, as if a model had failed.
    """
    w = Window.partitionBy(doc).orderBy(page)
    rows = pages.select(F.col(doc), F.col(page).alias("page_no"), F.struct(*pages.columns).alias("now"), F.lead(F.struct(*pages.columns)).over(w).alias("after"))
    return rows.select(doc, "page_no", F.when(F.col("after").isNull(), False).otherwise(F.coalesce(same, F.lit(True))).alias("same"), first.alias("c1"), F.when(F.col("after").isNotNull(), second).alias("c2"), F.col("after").isNull().alias("is_last"))


def lazy_groups(pairs: DataFrame, doc: str) -> DataFrame:
    """(document, group_no, classification, pages): a group ends where the next page isn't of the same document.

    The class is that of the first page in the first group, and of the page that began it in the others. One sort by document and page.
    """
    w = Window.partitionBy(doc).orderBy("page_no")
    begins = F.coalesce(~F.lag("same").over(w), F.lit(True))
    rows = pairs.withColumn("begins", begins).withColumn("before_c2", F.lag("c2").over(w))
    rows = rows.withColumn("group_no", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    label = F.when(F.col("group_no") == 1, F.col("c1")).otherwise(F.col("before_c2"))
    return rows.groupBy(doc, "group_no").agg(F.max(F.when(F.col("begins"), label)).alias("classification"), F.array_sort(F.collect_list(F.col("page_no").cast("int"))).alias("pages"))


def eager_prompts(pages: DataFrame, doc: str, page: str = "page_no", content: str = "content") -> DataFrame:
    """(document, content, num_pages): all pages with breaks between them, for one call."""
    return joined(pages, doc, page, content, PAGE_BREAK)


def eager_groups(answers: DataFrame, doc: str, raw: str = "raw", pages: str = "num_pages") -> DataFrame:
    """(document, group_no, classification, pages) from a model's JSON; where it can't be read, all pages are one group of class unknown."""
    read = F.from_json(F.get_json_object(raw, "$.groupOfDocuments"), GROUP)
    fallback = F.array(F.struct(F.sequence(F.lit(1), F.col(pages).cast("int")).alias("pages"), F.lit("unknown").alias("classification")))
    groups = F.when(F.coalesce(F.size(read), F.lit(0)) > 0, read).otherwise(fallback)
    return answers.select(doc, F.posexplode(groups).alias("at", "g")).select(doc, (F.col("at") + 1).alias("group_no"), "g.classification", "g.pages")


def group_pages(groups: DataFrame, pages: DataFrame, doc: str, page: str = "page_no") -> DataFrame:
    """The pages of each group, by number; ``pos`` is the place within the group."""
    wanted = groups.select(doc, "group_no", "classification", F.posexplode("pages").alias("pos", page)).withColumn(page, F.col(page).cast(pages.schema[page].dataType))
    return wanted.join(pages, [doc, page])
