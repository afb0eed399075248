"""Column functions on text: tokens, JSON found in model output, HTML, encodings, names of files and addresses.

All but the ones that say so are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ``strip`` takes off, in a form that Java and RE2 read alike.
BLANK = r"[\t-\r\x1C-\x20]"
TOKEN = r"[a-z]{1,20}|[0-9]+|[^a-z0-9\s]{1,2}"
PLACEHOLDER = r"\[(?:Image content not extracted|Image processing failed|Image content extraction failed)[^\]]*\]"


def strip(c: Column) -> Column:
    """Without white space at both ends; ``trim`` would take off plain spaces alone."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def token_count(c: Column) -> Column:
    """Tokens by rule: lower-case words of up to 20 letters, numbers, pairs of other signs; over 4 characters count by quarters."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.when(F.length(x) <= 4, F.lit(1).cast("long")).otherwise(F.floor(F.length(x) / 4)))


def paragraphs(c: Column, separator: str = "\n\n") -> Column:
    """Stripped parts between ``separator`` (a regular expression) that aren't blank."""
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def prefix(c: Column, n: int = 2000) -> Column:
    return F.left(c, F.lit(n))


# --- JSON in what models write


def parsed(c: Column) -> Column:
    """The text as JSON, or null where it isn't; a VARIANT."""
    return F.try_parse_json(c)


def first_json(c: Column) -> Column:
    """The text from the first brace to the next closing one, if that is JSON."""
    found = F.regexp_extract(c, r"(?s)\{.*?\}", 0)
    return F.when(parsed(found).isNotNull(), found)


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def thinking_json(c: Column) -> Column:
    """The JSON object in text that may think aloud first: fenced with a language, fenced, bare with one level of nesting, or all of it."""
    t = F.replace(F.replace(c, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))
    whole = strip(t)
    found = F.coalesce(
        _found(t, r"(?s)```json\s*(\{\s*.*?\})\s*```"),
        _found(t, r"(?s)```\s*(\{\s*.*?\})\s*```"),
        _found(t, r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})"),
        F.when(whole.startswith("{") & whole.endswith("}"), whole),
    )
    return F.replace(strip(found), F.lit("{content}"), F.lit(""))


def joined_json(parts: Column) -> Column:
    """One JSON text from the parts that a model wrote in several goes."""
    clean = lambda p: strip(F.replace(F.replace(F.replace(F.replace(p, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), F.lit("\njson"), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.array_join(F.filter(F.transform(parts, clean), lambda p: p != ""), "")


def continues_json(c: Column) -> Column:
    """Whether a part looks like JSON that can be continued."""
    return F.coalesce((c != "") & (c.contains("```json") | c.contains("{") | c.contains("[")), F.lit(False))


# --- encodings


def base64_text(c: Column) -> Column:
    """Base64 in one line; Spark's own breaks it every 76 characters."""
    return F.regexp_replace(F.base64(c), r"\s", "")


def data_uri(c: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), base64_text(c))


def without_data_uri(c: Column) -> Column:
    return F.when(c.startswith("data:"), F.regexp_replace(c, "^[^,]*,", "")).otherwise(c)


# --- files and addresses


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def is_url(c: Column) -> Column:
    """Whether a scheme and a host are there."""
    return F.coalesce(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+", 0), F.lit("")) != ""


_MAGIC = [
    ("pdf", "255044462D"),
    ("png", "89504E470D0A1A0A"),
    ("jpeg", "FFD8FF"),
    ("gif", "47494638"),
    ("bmp", "424D"),
    ("tiff", "49492A00"),
    ("tiff", "4D4D002A"),
    ("zip", "504B0304"),
]


def sniffed(content: Column) -> Column:
    """The kind of a file by its first bytes, or null; for binary columns."""
    start = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lit(False), F.lit(""))
    for kind, magic in _MAGIC:
        out = out.when(start.startswith(magic), kind)
    return out


def is_pdf(content: Column) -> Column:
    return F.coalesce(sniffed(content) == "pdf", F.lit(False))


# --- HTML

_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
REMOVED = ("script", "style", "nav", "footer")
HEADERS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _elements(tags: tuple[str, ...]) -> str:
    # no back-references: RE2 has none, so tags are written out
    return "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in tags)


def without_elements(html: Column, tags: tuple[str, ...] = REMOVED) -> Column:
    """Without comments and the elements of these tags, by regular expressions."""
    return F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), _elements(tags), "")


def html_headers(html: Column) -> Column:
    """The texts of h1 to h6, in order."""
    found = F.regexp_extract_all(without_elements(html), F.lit("(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in HEADERS)), F.lit(0))
    return F.transform(found, lambda x: strip(unescaped(F.regexp_replace(x, "(?s)<[^>]*>", ""))))


def unescaped(c: Column) -> Column:
    for entity, sign in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def one_line(c: Column) -> Column:
    """Lines and what double spaces part, stripped, joined by one space."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\r\n|[\n\x0B\x0C\r]|  "), strip), lambda x: x != ""), " ")


def html_text(html: Column, headers: str = "include", tags: tuple[str, ...] = REMOVED) -> Column:
    """Visible text by regular expressions; ``headers="summarize"`` leaves the texts of headers out."""
    if headers not in ("skip", "summarize", "include"):
        raise ValueError("headers is skip, summarize or include")
    c = without_elements(html, tags + HEADERS if headers == "summarize" else tags)
    return one_line(unescaped(F.regexp_replace(c, "(?s)<[^>]*>", "")))


class _Text(HTMLParser):
    def __init__(self, removed: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.removed, self.inside, self.out = removed, [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.removed:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(data)


def parsed_html_text(removed: tuple[str, ...] = REMOVED):
    """A pandas UDF with a real parser, for markup that regular expressions misread."""
    gone = frozenset(removed)

    @F.pandas_udf(T.StringType())
    def visible(html: pd.Series) -> pd.Series:
        def one(h: str | None) -> str | None:
            if h is None:
                return None
            p = _Text(gone)
            p.feed(h)
            p.close()
            return " ".join(x for line in "".join(p.out).splitlines() for x in (y.strip() for y in line.strip().split("  ")) if x)

        return html.map(one, na_action="ignore")

    return visible


def count_tokens(text: str) -> int:
    """``token_count`` for one Python string."""
    import re

    return sum(1 if len(t) <= 4 else len(t) // 4 for t in re.findall(TOKEN, text.lower()))


def cut_to_tokens(text: str, most: int) -> str:
    """A longer text up to a full stop, with an ellipsis. A binary search looks for the stop; each step tries the last one in the half that is left."""

    def upto(low: int, high: int) -> str:
        stop = text.rfind(".", low, high)
        return text[: (high if stop < 0 else stop) + 1]

    if count_tokens(text) <= most:
        return text
    low, high = 0, len(text)
    while low < high:
        middle = (low + high) // 2
        if count_tokens(upto(low, middle)) <= most:
            low = middle + 1
        else:
            high = middle
    return upto(0, low) + "..."


def truncated(most: int):
    """A pandas UDF: texts over ``most`` tokens are cut by a binary search, which no built-in expression can follow exactly."""

    @F.pandas_udf(T.StringType())
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: cut_to_tokens(t, most), na_action="ignore")

    return cut


def yaml_block(data: Column) -> Column:
    """A JSON text as a YAML block; other texts stay, null is empty. Needs PyYAML on the workers."""

    @F.pandas_udf(T.StringType())
    def block(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t: str | None) -> str:
            if not t:
                return ""
            try:
                return yaml.safe_dump(json.loads(t), allow_unicode=True, sort_keys=False)
            except ValueError:
                return t

        return texts.map(one)

    return block(data)


def yaml_to_json(data: Column) -> Column:
    """A YAML text as JSON, null where it isn't YAML."""

    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(yaml.safe_load(t), ensure_ascii=False, default=str)
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return convert(data)


# --- values


def status_name(c: Column) -> Column:
    """The state of a remote batch job as queued, processing, completed or failed."""
    s = F.lower(strip(c))
    return F.when(s == "validating", "queued").when(s.isin("in_progress", "finalizing"), "processing").when(s == "completed", "completed").otherwise("failed")


def with_placeholder_note(c: Column, note: str) -> Column:
    """The text, with ``note`` after it if it holds a place that an image left empty."""
    return F.when(c.rlike(PLACEHOLDER), F.concat(c, F.lit("\n"), F.lit(note))).otherwise(c)


def images_filled(c: Column, images: Column) -> Column:
    """Image references replaced by what was read in them: ``images`` is an array of (id, text)."""
    return F.aggregate(images, c, lambda t, i: F.replace(t, F.concat(F.lit("!["), i["id"], F.lit("]("), i["id"], F.lit(")")), F.concat(F.lit("[Image content: "), i["text"], F.lit("]"))))


def anchored(text: Column, start: Column, end: Column) -> Column:
    """The part of a text between two offsets from 0."""
    return F.substring(text, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))
