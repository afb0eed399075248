"""Extensions and media types, a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# by family: type/subtype and the extensions that have it
_BY_TYPE = """
application: acad dwg|dxf dxf|epub+zip epub|gzip gz|json json|mathematica nb|msword doc|pdf pdf|postscript ai eps ps|rtf rtf|sql sql|toml toml|zip zip
application: vnd.amazon.ebook azw azw3|vnd.apple.keynote key|vnd.ms-excel xls|vnd.ms-outlook msg|vnd.ms-powerpoint ppt
application: vnd.oasis.opendocument.presentation odp|vnd.oasis.opendocument.spreadsheet ods|vnd.oasis.opendocument.text odt
application: vnd.openxmlformats-officedocument.presentationml.presentation pptx|vnd.openxmlformats-officedocument.spreadsheetml.sheet xlsx
application: vnd.openxmlformats-officedocument.wordprocessingml.document docx|x-7z-compressed 7z|x-matlab-data mat|x-mobipocket-ebook mobi
application: x-rar-compressed rar|x-sqlite3 db sqlite|x-tar tar|x-tex tex|xhtml+xml htm html xhtml|xml xml|yaml yaml yml|csv csv|svg+xml svg
audio: aac aac|flac flac|mp4 m4a|mpeg mp3|ogg ogg|wav wav
font: otf otf|ttf ttf|woff woff|woff2 woff2
image: bmp bmp|gif gif|heic heic|heif heif|jpeg jpeg jpg|jpg jpeg jpg|png png|svg+xml svg|tiff tif tiff|webp webp|x-icon ico|x-raw raw
message: rfc822 eml
model: obj obj|stl stl
text: css css|csv csv|html htm html|javascript js|markdown markdown md|plain conf ini txt|tab-separated-values tsv|xml xml|x-markdown markdown md
text: x-c c|x-c++src cpp|x-go go|x-java-source java|x-python py|x-r r|x-rust rs|x-swift swift|yaml yaml yml
video: mp4 mp4|quicktime mov|webm webm|x-flv flv|x-matroska mkv|x-ms-wmv wmv|x-msvideo avi
"""

MIME: list[tuple[str, str]] = [
    (ext, f"{line.split(': ')[0]}/{entry.split()[0]}") for line in _BY_TYPE.strip().splitlines() for entry in line.split(": ", 1)[1].split("|") for ext in entry.split()[1:]
]


def mime_table(spark: SparkSession) -> DataFrame:
    """(place, ext, mime)."""
    return spark.createDataFrame([(i, e, m) for i, (e, m) in enumerate(MIME)], "place int, ext string, mime string")


def accepts(mime: Column, extensions: list[str]) -> Column:
    """Whether a media type belongs to one of these extensions."""
    return mime.isin(*{m for e, m in MIME if e in extensions})


def extension_of(mime: Column, default: str = "txt") -> Column:
    """The first extension of a media type."""
    first: dict[str, str] = {}
    for e, m in MIME:
        first.setdefault(m, e)
    table = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mime), F.lit(default))
