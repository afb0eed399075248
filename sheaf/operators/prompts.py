"""What models are sent, as columns, and batch files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import data_uri

CONTENT, EXTRA, CONTINUE = "##Content\n\n", "##Extra Content\n\n", "## CONTINUE JSON"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_text(content: Column, extra: Column | None = None) -> Column:
    body = F.concat(F.lit(CONTENT), content)
    return body if extra is None else F.when(extra.isNotNull(), F.concat(F.lit(EXTRA), extra, F.lit("\n\n"), body)).otherwise(body)


def messages(system: str, content: Column, extra: Column | None = None) -> Column:
    """System and user messages; extra content stands before the content, once."""
    return F.array(message("system", F.lit(system)), message("user", prompt_text(content, extra)))


def image_parts(images: Column, mime: str = "image/jpeg") -> Column:
    """Binary images as parts of a message; null is none."""
    return F.transform(F.coalesce(images, F.array().cast("array<binary>")), lambda b: F.struct(F.lit("image_url").alias("type"), data_uri(b, mime).alias("image_url")))


def dynamic_prompt(prompt: Column) -> Column:
    """For models that think aloud: reasoning between tags first, then the JSON in a fence."""
    return F.concat(prompt, F.lit("\n\nReason step by step between <think> and </think>. Then give the result as JSON:\n```json\n{...}\n```"))


def metadata(page: Column, apart: tuple[str, ...] = ("text", "images", "image", "content")) -> Column:
    """A map of a page's entries without its text and images."""
    return F.map_filter(page, lambda k, _: ~k.isin(*apart))


def entry(m: Column, key: str, default: Column) -> Column:
    """A map's value, or ``default`` where the map or the key is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), default)


def continuation(sent: Column, partial: Column) -> Column:
    return F.concat(sent, F.array(message("assistant", partial), message("user", F.lit(CONTINUE))))


def classification_prompt(classes: list[tuple[str, str, T.StructType | None]]) -> str:
    """The classes with their descriptions and the fields of their contracts."""
    from sheaf.schema import rendered

    return "\n".join(f"{n}: {d}" + (f"\n{rendered(s)}" if s else "") for n, d, s in classes)


def conflict_prompt(conflicts: DataFrame, pages: DataFrame, key: str, page: str = "page_no", content: str = "content") -> DataFrame:
    """(key, prompt): fields in conflict with their candidates, and the pages they come from."""
    told = conflicts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("field"), F.lit(": "), F.array_join("candidates", " | ")))), "\n").alias("told"))
    text = pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, content))), lambda p: F.concat(F.lit("Page "), p[page].cast("string"), F.lit(":\n"), p[content])), "\n\n").alias("text"))
    return told.join(text, key).select(key, F.concat(F.lit("Choose one value for each field.\n"), F.col("told"), F.lit("\n\n"), F.col("text")).alias("prompt"))


def batch_lines(requests: DataFrame, custom_id: str, model: str, most: int = 8000, temperature: float = 0.0, msgs: str = "messages") -> DataFrame:
    """(custom_id, line): one JSON request a row, as batch endpoints take them."""
    body = F.struct(F.lit(model).alias("model"), F.col(msgs).alias("messages"), F.lit(most).alias("max_tokens"), F.lit(temperature).alias("temperature"))
    line = F.to_json(F.struct(F.col(custom_id).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return requests.select(F.col(custom_id).cast("string").alias("custom_id"), line.alias("line"))


def batch_results(lines: DataFrame, contract: T.StructType, line: str = "line") -> DataFrame:
    """(custom_id, raw, parsed, status) of every line, those that don't parse included."""
    raw = F.get_json_object(line, "$.response.body.choices[0].message.content")
    out = lines.select(F.get_json_object(line, "$.custom_id").alias("custom_id"), raw.alias("raw"))
    good = F.try_parse_json("raw").isNotNull()
    return out.select("custom_id", "raw", F.when(good, F.from_json("raw", contract)).alias("parsed"), F.when(F.coalesce(good, F.lit(False)), "ok").otherwise("unparsed").alias("status"))


def markdown_page(content: Column, image: Column, error: Column | None = None, page: Column | None = None) -> Column:
    """A page as text with its image; a page that failed is a comment."""
    text = F.when(image.isNotNull(), F.concat(F.coalesce(content, F.lit("")), F.lit("\n![page]("), data_uri(image, "image/png"), F.lit(")"))).otherwise(F.coalesce(content, F.lit("")))
    if error is None:
        return text
    return F.when(error.isNotNull(), F.concat(F.lit("<!-- Error processing page "), page.cast("string"), F.lit(": "), error, F.lit(" -->"))).otherwise(text)
