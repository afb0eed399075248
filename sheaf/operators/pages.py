"""Documents as rows of pages: (document, page number, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as X

BETWEEN_PAGES, BETWEEN_DOCUMENTS, PAGE_BREAK = "\n\n", "\n\n--- Document Separator ---\n\n", "\n=== PAGE BREAK ===\n"


def ordered(values: str, *by: str) -> Column:
    """Values of a group as an array in the order of ``by``; what the group is collected in doesn't matter."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, values))), lambda x: x[values])


def txt_pages(docs: DataFrame, doc: str = "doc_id", text: str = "text", separator: str | None = None, keep_blanks: bool = False) -> DataFrame:
    """One page a text, or one a part between separators; blank parts are no pages."""
    if separator is None:
        return docs.select(doc, F.lit(1).alias("page_no"), (F.col(text) if keep_blanks else X.strip(F.col(text))).alias("content"))
    parts = X.paragraphs(F.col(text), separator)
    return docs.select(doc, F.posexplode(parts).alias("at", "content")).select(doc, (F.col("at") + 1).alias("page_no"), "content")


def without_images(pages: DataFrame) -> DataFrame:
    return pages.drop("image", "images")


def joined(pages: DataFrame, doc: str, page: str = "page_no", content: str = "content", between: str = BETWEEN_PAGES) -> DataFrame:
    """(document, content, num_pages): pages in order, empty and null ones left out of the text."""
    kept = F.filter(ordered(content, page), lambda x: F.coalesce(x, F.lit("")) != "")
    return pages.groupBy(doc).agg(F.array_join(kept, between).alias("content"), F.count(F.lit(1)).alias("num_pages"))


def merged_documents(docs: DataFrame, group: str, doc: str, content: str = "content", pages: str = "num_pages", extra: str | None = None) -> DataFrame:
    """(group, content, num_documents, num_pages): several sources as one, with a separator, after extra content if there is some."""
    text = F.array_join(ordered(content, doc), BETWEEN_DOCUMENTS)
    if extra:
        text = F.concat(F.lit(extra + BETWEEN_DOCUMENTS), text)
    return docs.groupBy(group).agg(text.alias("content"), F.count(F.lit(1)).alias("num_documents"), F.greatest(F.lit(1).cast("long"), F.sum(F.coalesce(pages, F.lit(1)))).alias("num_pages"))


def with_sheet_names(pages: DataFrame, content: str = "content", sheet: str = "sheet_name") -> DataFrame:
    """The name of a sheet after its content, unless the content mentions it."""
    named = F.concat(F.col(content), F.lit("\nSheet: "), F.col(sheet))
    return pages.withColumn(content, F.when(F.col(sheet).isNull() | F.contains(F.col(content), F.col(sheet)), F.col(content)).otherwise(named))


def selected(pages: DataFrame, wanted: list[int], page: str = "page_no") -> DataFrame:
    """Pages in the order asked for (``pos`` from 1), as often as asked for. Numbers count from 1."""
    if any(not isinstance(n, int) or n < 1 for n in wanted):
        raise ValueError("page numbers are whole and count from 1")
    rows = F.filter(F.transform(F.array(*map(F.lit, wanted)), lambda n, i: F.struct((i + 1).alias("pos"), n.alias("n"))), lambda x: x["n"] == F.col(page))
    return pages.where(F.col(page).isin(*set(wanted))).withColumn("asked", F.explode(rows)).select(F.col("asked.pos").alias("pos"), *pages.columns)


def with_page_guard(pages: DataFrame, doc: str, least: int = 2) -> DataFrame:
    """(document, pages, status): whether there is enough to split."""
    n = F.count(F.lit(1))
    return pages.groupBy(doc).agg(n.alias("pages"), F.when(n < least, "too_few_pages").otherwise("ok").alias("status"))


def page_pairs(pages: DataFrame, doc: str, page: str = "page_no", content: str = "content") -> DataFrame:
    """(document, page, content, next page, next content): a document of one page is a pair with nothing after it."""
    w = Window.partitionBy(doc).orderBy(page)
    out = pages.select(doc, F.col(page).alias("page_no"), F.col(content).alias("content"), F.lead(page).over(w).alias("next_page_no"), F.lead(content).over(w).alias("next_content"), F.count(F.lit(1)).over(Window.partitionBy(doc)).alias("pages"))
    return out.where("next_page_no is not null or pages = 1").drop("pages")


def chunks(docs: DataFrame, most: int, doc: str = "doc_id", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(document, chunk_no, tokens, content): paragraphs packed in order while the chunk stays within ``most`` tokens.

    A paragraph that is too long is a chunk by itself. The fold over a document's paragraphs is one built-in expression.
    """
    glue = F.lit("\n\n")
    piece = "struct<tokens:bigint,content:string>"
    parts = F.transform(X.paragraphs(F.col(text), separator), lambda p: F.struct(X.token_count(p).alias("tokens"), p.alias("content")))
    start = F.struct(F.array().cast(f"array<{piece}>").alias("done"), F.lit(None).cast(piece).alias("now"))

    def step(a: Column, p: Column) -> Column:
        now = a["now"]
        fits = now["tokens"] + p["tokens"] + 1 <= most
        longer = F.struct((now["tokens"] + p["tokens"]).alias("tokens"), F.concat(now["content"], glue, p["content"]).alias("content"))
        return (
            F.when(now.isNull(), F.struct(a["done"].alias("done"), p.alias("now")))
            .when(fits, F.struct(a["done"].alias("done"), longer.alias("now")))
            .otherwise(F.struct(F.concat(a["done"], F.array(now)).alias("done"), p.alias("now")))
        )

    folded = F.aggregate(parts, start, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return docs.select(doc, F.posexplode(folded).alias("at", "c")).select(doc, (F.col("at") + 1).alias("chunk_no"), "c.tokens", "c.content")
