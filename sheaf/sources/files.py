"""Files into pages: text, HTML, tables, labels; formats whose codecs are absent raise a clear error."""

from __future__ import annotations

import csv
import importlib.util
import io
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import text as X
from sheaf.operators import pages as P
from sheaf.operators.tables import row_text


class MissingCodec(RuntimeError):
    """A format needs a library or service that isn't there."""


def read_txt(spark: SparkSession, path: str, separator: str | None = None, keep_blanks: bool = False) -> DataFrame:
    """(path, page_no, content) of text files, whole or by paragraphs."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return P.txt_pages(t, "path", "text", separator, keep_blanks)


def read_html(spark: SparkSession, path: str, headers: str = "include", exact: bool = False) -> DataFrame:
    """(path, page_no, content) of HTML files; ``exact`` reads them with a real parser."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    content = X.parsed_html_text()("html") if exact else X.html_text(F.col("html"), headers)
    return t.select("path", F.lit(1).alias("page_no"), content.alias("content"))


@F.pandas_udf(T.StringType())
def sheet_text(files: pd.Series) -> pd.Series:
    """A CSV file as text: cells between bars, empty ones kept, rows as lines, rows of empty cells left out. Quoted cells may hold commas and line breaks."""

    def one(text: str) -> str:
        rows = csv.reader(io.StringIO(text, newline=""))
        return "\n".join(" | ".join(cells) for cells in rows if any(cells))

    limit = csv.field_size_limit(2**31 - 1)
    try:
        return files.map(one, na_action="ignore")
    finally:
        csv.field_size_limit(limit)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, content, is_spreadsheet): a file is a sheet. Rows may have any number of cells."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    return t.select("path", F.lit(1).alias("page_no"), sheet_text("v").alias("content"), F.lit(True).alias("is_spreadsheet"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, expected) of a JSON object keyed by file name; ``expected`` is JSON text."""
    t = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,variant>")
    return t.select(F.explode(m).alias("doc_id", "v")).select(F.lower(F.trim("doc_id")).alias("doc_key"), "doc_id", F.to_json("v").alias("expected")).drop("doc_key")


def read_data(spark: SparkSession, items: object, vision: bool = False) -> DataFrame:
    """Pages from values in memory: a text, which may be a file's path, a stream, one page as a dict, or a list of pages. Each page needs ``content``.

    A page without an image has none, or with ``vision`` an empty one.
    """
    if isinstance(items, str):
        try:
            with open(items, encoding="utf-8") as f:
                items = f.read()
        except (OSError, ValueError):  # no path, so the text itself
            pass
        items = [{"content": items}]
    elif hasattr(items, "read"):
        got = items.read()
        items = [{"content": got.decode("utf-8") if isinstance(got, bytes) else got}]
    elif isinstance(items, dict):
        items = [items]
    elif not isinstance(items, list):
        raise ValueError("a text, a stream, a dict or a list of dicts is needed")
    for i in items:
        if not isinstance(i, dict) or "content" not in i:
            raise ValueError("each page is a dict with content")
    rows = [(n + 1, i["content"], i.get("image", b"" if vision else None)) for n, i in enumerate(items)]
    return spark.createDataFrame(rows, "page_no int, content string, image binary")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind) of any files, with their kind by first bytes."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", "content", X.sniffed(F.col("content")).alias("kind"))


@dataclass(frozen=True)
class Loader:
    """A named reader of some extensions; ``needs`` is the Python library or service that it can't do without."""

    name: str
    extensions: tuple[str, ...]
    read: Callable[..., DataFrame] | None = None
    needs: str | None = None

    def __call__(self, spark: SparkSession, path: str, **options: object) -> DataFrame:
        if self.read is None:
            there = bool(self.needs) and importlib.util.find_spec(self.needs) is not None
            raise MissingCodec(f"{self.name} needs {self.needs}, which {'has no adapter registered' if there else 'is not installed'}; register a reader with files.register")
        return self.read(spark, path, **options)


IMAGES = ("bmp", "jpeg", "jpg", "png", "tiff")
LOADERS: dict[str, Loader] = {
    x.name: x
    for x in (
        Loader("txt", ("txt",), read_txt),
        Loader("html", ("htm", "html"), read_html),
        Loader("csv", ("csv",), read_csv),
        Loader("spreadsheet", ("ods", "odt", "odf", "xls", "xlsb", "xlsm", "xlsx"), needs="openpyxl"),
        Loader("pypdf", ("pdf",), needs="pypdf"),
        Loader("pdfplumber", ("pdf",), needs="pdfplumber"),
        Loader("word", ("doc", "docx"), needs="docx2txt"),
        Loader("markitdown", ("epub", "pptx", "msg"), needs="markitdown"),
        Loader("docling", ("adoc", "md"), needs="docling"),
        Loader("tesseract", IMAGES, needs="pytesseract"),
        Loader("easy_ocr", (*IMAGES, "tif", "webp"), needs="easyocr"),
        Loader("llm_image", ("pdf", *IMAGES), needs="PIL"),
        Loader("document_intelligence", ("pdf", *IMAGES), needs="azure"),
        Loader("textract", ("pdf", "jpeg", "png", "tiff"), needs="boto3"),
        Loader("document_ai", ("pdf", *IMAGES), needs="google"),
        Loader("mistral_ocr", ("pdf", *IMAGES), needs="mistralai"),
    )
}


def register(loader: Loader) -> None:
    """Adds a loader, or puts one in the place of another: the way to plug in a codec."""
    LOADERS[loader.name] = loader


def route(extension: str, primary: str | None = None) -> Loader | None:
    """The primary loader if it handles the extension, else one that can be read here, else the first that names it."""
    if primary and extension in LOADERS[primary].extensions:
        return LOADERS[primary]
    fits = [x for x in LOADERS.values() if extension in x.extensions]
    return next((x for x in fits if x.read), fits[0] if fits else None)


VISION = ("pdf", "jpg", "jpeg", "png", "tiff", "bmp")


def sees(path: Column, content: Column | None = None) -> Column:
    """Whether a source can be shown to a model as images: an address, a PDF or an image by its extension, or by its first bytes."""
    by_name = X.is_url(path) | X.extension(path).isin(*VISION)
    return by_name if content is None else by_name | F.coalesce(X.sniffed(content).isin("pdf", "jpg", "jpeg", "png", "tiff", "bmp", "gif"), F.lit(False))


def paginates(path: Column, content: Column | None = None) -> Column:
    """Whether a source has pages of its own: PDF only."""
    by_name = X.extension(path) == "pdf"
    return by_name if content is None else by_name | X.is_pdf(content)


def choose(source: object, primary: str | None = None, vision: bool = False) -> str | None:
    """The name of the loader of a source: the primary one if it can, the one of the extension, values in memory, with ``vision`` an image loader; else None."""
    if isinstance(source, (list, dict)) or hasattr(source, "read"):
        return "data"
    ext = str(source).rsplit(".", 1)[-1].lower() if "." in str(source).rsplit("/", 1)[-1] else ""
    found = route(ext, primary)
    if found is not None:
        return found.name
    return "llm_image" if vision and (ext in VISION or str(source).startswith(("http://", "https://"))) else None


def load_folder(spark: SparkSession, path: str, primary: str | None = None) -> DataFrame:
    """(path, page_no, content) of a folder of mixed files: those of each extension by their loader, as one table.

    The extensions come from a listing of names; files that no loader reads have one row without content and an error.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", X.extension(F.col("path")).alias("ext"))
    out = None
    for ext in sorted(r["ext"] for r in names.select("ext").distinct().collect()):
        loader = route(ext, primary)
        if loader is not None and loader.read is not None:
            pages = loader(spark, f"{path.rstrip('/')}/*.{ext}")
            pages = pages.select("path", "page_no", "content", F.lit(None).cast("string").alias("error"))
        else:
            why = "no loader" if loader is None else f"{loader.name} needs {loader.needs}"
            pages = names.where(F.col("ext") == ext).select("path", F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("content"), F.lit(why).alias("error"))
        out = pages if out is None else out.unionByName(pages)
    return spark.createDataFrame([], "path string, page_no int, content string, error string") if out is None else out


def load(spark: SparkSession, path: str, primary: str | None = None, **options: object) -> DataFrame:
    """The pages of the files at ``path``, by the loader of its extension."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    loader = route(ext, primary)
    if loader is None:
        raise ValueError(f"no loader for {path!r}")
    return loader(spark, path, **options)


def sheet_row(*cells: str):
    return row_text([F.col(c) for c in cells])
