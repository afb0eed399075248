"""Tables and forms: rendering, cleaning, and what recognition services answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import strip
from sheaf.operators.pages import ordered

TABLES = "array<array<array<string>>>"


def row_text(cells: list[Column], between: str = " | ") -> Column:
    """Cells of a row; null is empty, and a row of empty cells is null."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    return F.when(F.exists(F.array(*texts), lambda x: strip(x) != ""), F.concat_ws(between, *texts))


def rendered_sheet(rows: DataFrame, sheet: str, order: str, cells: list[str]) -> DataFrame:
    """(sheet, content): rows as lines; empty ones go."""
    lines = rows.select(sheet, order, row_text([F.col(c) for c in cells]).alias("line")).where("line is not null")
    return lines.groupBy(sheet).agg(F.array_join(ordered("line", order), "\n").alias("content"))


def cleaned(tables: Column) -> Column:
    """Cells stripped, null as empty; rows and tables without any text go."""
    rows = lambda t: F.filter(F.transform(t, lambda r: F.transform(r, lambda c: F.coalesce(strip(c), F.lit("")))), lambda r: F.exists(r, lambda c: c != ""))
    return F.filter(F.transform(tables, rows), lambda t: F.size(t) > 0)


def markdown_table(table: Column) -> Column:
    """An array of rows as a Markdown table, the first row being the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(table[0])))
    return F.when(F.size(table) > 0, F.array_join(F.concat(F.array(line(table[0]), rule), F.transform(F.slice(table, F.lit(2), F.size(table)), line)), "\n")).otherwise("")


def element_markdown(label: Column, text: Column) -> Column:
    """One recognised element as Markdown."""
    return (
        F.when(label == "TITLE", F.concat(F.lit("# "), text))
        .when(label == "SECTION_HEADER", F.concat(F.lit("## "), text))
        .when(label == "CODE", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(label == "LIST_ITEM", F.concat(F.lit("- "), text))
        .otherwise(text)
    )


def elements_markdown(elements: DataFrame, doc: str, order: str, label: str = "label", text: str = "text") -> DataFrame:
    e = elements.select(doc, order, element_markdown(F.col(label), F.col(text)).alias("line"))
    return e.groupBy(doc).agg(F.array_join(ordered("line", order), "\n").alias("content"))


def lines_outside_tables(lines: DataFrame, cells: DataFrame, on: list[str], line: str, cell: str) -> DataFrame:
    """Lines less cells, as multisets: a cell takes one equal line away."""
    return lines.select(*on, line).exceptAll(cells.select(*on, F.col(cell).alias(line)))


def built_tables(cells: DataFrame, by: list[str], row: str, column: str, text: str) -> DataFrame:
    """(…, rows): cells as a dense matrix by row and column from 1; missing ones are empty."""
    size = F.struct(F.max(row).alias("r"), F.max(column).alias("c"))
    whole = F.map_from_entries(F.collect_list(F.struct(F.struct(F.col(row).cast("int").alias("r"), F.col(column).cast("int").alias("c")).alias("k"), F.col(text).alias("v"))))
    one = cells.groupBy(*by, row, column).agg(F.max(text).alias(text))
    g = one.groupBy(*by).agg(size.alias("size"), whole.alias("at"))
    dense = F.transform(F.sequence(F.lit(1), F.col("size.r").cast("int")), lambda r: F.transform(F.sequence(F.lit(1), F.col("size.c").cast("int")), lambda c: F.coalesce(F.try_element_at("at", F.struct(r.alias("r"), c.alias("c"))), F.lit(""))))
    return g.select(*by, dense.alias("rows"))


def page_of_blocks(blocks: DataFrame, doc: str, order: str, kind: str = "block_type") -> DataFrame:
    """Blocks with the page they are on: a PAGE block begins one."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("page_no", F.sum((F.col(kind) == "PAGE").cast("int")).over(w))


def block_lines(blocks: DataFrame, doc: str, order: str, kind: str = "block_type", text: str = "text") -> DataFrame:
    """(document, page_no, content): the lines of each page."""
    on = page_of_blocks(blocks, doc, order, kind)
    return on.where(F.col(kind) == "LINE").groupBy(doc, "page_no").agg(F.array_join(ordered(text, order), "\n").alias("content"))


def form_fields(blocks: DataFrame, doc: str) -> DataFrame:
    """(document, key, value) of KEY blocks, from (document, block_id, block_type, text, children, value_ids): two joins on block ids."""
    words = blocks.where("block_type = 'WORD'").select(doc, F.col("block_id").alias("child"), "text")

    def spoken(b: DataFrame, name: str) -> DataFrame:
        w = b.select(doc, "block_id", F.posexplode("children").alias("pos", "child")).join(words, [doc, "child"])
        return w.groupBy(doc, "block_id").agg(F.array_join(ordered("text", "pos"), " ").alias(name))

    keys = blocks.where("block_type = 'KEY'")
    names = spoken(keys, "key")
    links = keys.select(doc, "block_id", F.explode("value_ids").alias("value_id"))
    values = spoken(blocks.where("block_type = 'VALUE'"), "value").withColumnRenamed("block_id", "value_id")
    return names.join(links, [doc, "block_id"], "left").join(values, [doc, "value_id"], "left").select(doc, "key", F.coalesce("value", F.lit("")).alias("value"))


def pairs_of_page(pairs: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """(document, page_no, key, value): pairs whose key is on the page, or nowhere; of equal keys the last."""
    p = pairs.where("key <> '' and value <> ''").select(doc, "key", "value", "place", F.coalesce("regions", F.array().cast("array<int>")).alias("regions"))
    rows = pages.select(doc, "page_no").join(p, doc).where((F.size("regions") == 0) | F.array_contains("regions", F.col("page_no")))
    return rows.groupBy(doc, "page_no", "key").agg(F.max_by("value", "place").alias("value"))


def fragments_text(fragments: Column) -> Column:
    """Recognised fragments (with ``text``) as one text."""
    return F.array_join(F.transform(fragments, lambda f: f["text"]), " ")


def recognition_options(languages: tuple[str, ...] = ("eng",), page_mode: int = 3, engine: int = 3, variables: dict[str, str] | None = None) -> str:
    """The command-line options of a character recognition run, checked."""
    if page_mode not in range(14) or engine not in range(4):
        raise ValueError("page modes go from 0 to 13, engines from 0 to 3")
    return " ".join([f"--psm {page_mode} --oem {engine} -l {'+'.join(languages)}", *(f"-c {k}={v}" for k, v in (variables or {}).items())])


def form_pairs(fields: Column) -> Column:
    """Form fields as (key, value) of what has a name, blanks aside."""
    pairs = F.transform(fields, lambda f: F.struct(F.trim(f["name"]).alias("key"), F.trim(F.coalesce(f["value"], F.lit(""))).alias("value")))
    return F.filter(pairs, lambda p: F.coalesce(p["key"] != "", F.lit(False)))


def with_page_images(pages: DataFrame, images: DataFrame, key: str, page: str = "page_no", image: str = "image") -> DataFrame:
    """Pages with their image, by number; null where there is none."""
    return pages.join(images.select(key, page, image), [key, page], "left")


def sorted_entries(m: Column) -> Column:
    """A map's entries by key."""
    return F.array_sort(F.map_entries(m))
