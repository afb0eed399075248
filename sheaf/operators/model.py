"""Model calls: an expensive function from prompts to text, behind one interface.

A backend takes an iterator of pandas frames with a ``prompt`` and gives (raw, error, input_tokens, output_tokens). Equal prompts are asked once. What comes
back is written before more than one plan reads it, so that no model is asked twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema
from sheaf.functions import numbers
from sheaf.functions import text as X
from sheaf.operators import merge
from sheaf.operators.pages import joined

ANSWER = "raw string, error string, input_tokens bigint, output_tokens bigint"
Backend = Callable[[str], str]
FORBIDDEN, PAGINATE, CONCATENATE = "forbidden", "paginate", "concatenate"


def asked(prompts: DataFrame, backend: Backend, key: str = "prompt", tries: int = 2, **read: Column) -> DataFrame:
    """``prompts`` with raw, error and token counts. Distinct prompts are sent; a failure is retried and then is a value, not a failed task.

    A null prompt isn't sent: its row stays, with the error no_content. Answers are joined by the prompt's hash. ``read``: columns made of raw, once an answer; without an answer they are null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for h, p in zip(f["prompt_hash"], f[key], strict=True):
                raw, error = None, None
                for _ in range(tries):
                    try:
                        raw, error = backend(p), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a backend raises becomes the row's error
                        error = f"{type(e).__name__}: {e}"
                rows.append((h, raw, error))
            yield pd.DataFrame(rows, columns=["prompt_hash", "raw", "error"])

    hashed = prompts.withColumn("prompt_hash", F.unhex(F.sha2(key, 256)))
    # distinct by both columns: the first prompt of each hash would be found by sorting all rows
    sent = hashed.where(F.col(key).isNotNull()).select("prompt_hash", key).distinct()
    answers = sent.mapInPandas(run, "prompt_hash binary, raw string, error string").withColumns(read)
    out = hashed.withColumn("input_tokens", F.coalesce(X.token_count(F.col(key)), F.lit(0)).cast("long")).join(answers, "prompt_hash", "left").drop("prompt_hash")
    error = F.when(F.col(key).isNull(), F.lit("no_content")).otherwise(F.col("error"))
    return out.select(*prompts.columns, "raw", error.alias("error"), "input_tokens", F.coalesce(X.token_count(F.col("raw")), F.lit(0)).cast("long").alias("output_tokens"), *read)


@dataclass(frozen=True)
class Settings:
    """How a model is asked. Thinking, once set either way, fixes the temperature at 1; the budget follows the content."""

    model: str
    temperature: float = 0.0
    thinking: bool | None = None
    dynamic: bool = False
    timeout_s: int = 3000
    token_limit: int | None = None

    def __post_init__(self) -> None:
        if not self.model:
            raise ValueError("a model is needed")

    @property
    def heat(self) -> float:
        return self.temperature if self.thinking is None else 1.0

    def request(self, msgs: Column, pages: Column) -> Column:
        """The request as a struct; budgets follow the number of pages."""
        thinking = numbers.thinking_tokens(pages)
        most = numbers.answer_tokens(F.lit(self.token_limit).cast("int"), thinking, F.lit(bool(self.thinking)))
        budget = F.when(F.lit(bool(self.thinking)), thinking)
        return F.struct(F.lit(self.model).alias("model"), msgs.alias("messages"), F.lit(self.heat).alias("temperature"), most.alias("max_tokens"), budget.alias("thinking_tokens"), F.lit(self.timeout_s).alias("timeout"))


class FallbackBackend:
    """Backends in order of preference; the next is asked where one fails."""

    def __init__(self, *backends: Backend) -> None:
        self.backends = backends

    def __call__(self, prompt: str) -> str:
        problem: Exception | None = None
        for b in self.backends:
            try:
                return b(prompt)
            except Exception as e:  # noqa: BLE001
                problem = e
        raise problem or ValueError("no backend")


class RegexBackend:
    """An offline stand-in for a model: one pattern a field, its first group being the value."""

    def __init__(self, patterns: dict[str, str]) -> None:
        self.patterns = patterns

    def __call__(self, prompt: str) -> str:
        import json

        found = {f: re.search(p, prompt, re.M) for f, p in self.patterns.items()}
        return json.dumps({f: m.group(1) for f, m in found.items() if m})


class KeywordBackend:
    """Classifies by the first keyword that a prompt holds."""

    def __init__(self, keywords: list[tuple[str, str, int]]) -> None:
        self.keywords = keywords

    def __call__(self, prompt: str) -> str:
        import json

        for word, name, confidence in self.keywords:
            if word in prompt.lower():
                return json.dumps({"name": name, "confidence": confidence})
        return json.dumps({"name": "Unknown", "confidence": 1})


def continued(backend: Backend, tries: int = 3) -> Backend:
    """Asks on while an answer is cut off, up to ``tries`` times, and joins the parts."""
    import json

    def call(prompt: str) -> str:
        parts: list[str] = []
        for k in range(tries + 1):
            parts.append(backend(prompt if not k else f"{prompt}\n{''.join(parts)}\n## CONTINUE JSON"))
            whole = "".join(p.replace("```json", "").replace("```", "").replace("\njson", "").replace("\n", " ").strip() for p in parts)
            try:
                json.loads(whole)
                return whole
            except ValueError:
                continue
        raise ValueError("no whole JSON after the last continuation")

    return call


def extracted(docs: DataFrame, backend: Backend, contract: T.StructType, key: str, content: str = "content") -> DataFrame:
    """(key, the contract's fields, schema_valid, error): one call a document; what is cut off or doesn't fit is not valid."""
    prompts = docs.select(key, F.concat(F.lit("##Content\n\n"), F.col(content)).alias("prompt"))
    a = asked(prompts, backend, r=schema.read(X.thinking_json(F.col("raw")), contract))
    return a.select(key, "r.parsed.*", F.coalesce("r.valid", F.lit(False)).alias("schema_valid"), "error")


def extracted_by_page(pages: DataFrame, backend: Backend, contract: T.StructType, key: str, page: str = "page_no", content: str = "content") -> DataFrame:
    """(key, fields as value, candidates, conflict): one call a page, in page order merged; a failed page is all null."""
    relaxed = schema.relaxed(contract)
    prompts = pages.select(key, page, F.concat(F.lit("##Content\n\n"), F.col(content)).alias("prompt"))
    a = asked(prompts, backend, p=schema.read(X.thinking_json(F.col("raw")), relaxed)["parsed"]).select(key, page, "p.*")
    texts = tuple(f.name for f in contract.fields if isinstance(f.dataType, T.StringType))
    return merge.scalars(a, [key], [f.name for f in contract.fields], page, texts)


def extract(pages: DataFrame, backend: Backend, contract: T.StructType, key: str, strategy: str = FORBIDDEN, page: str = "page_no", content: str = "content") -> DataFrame:
    """By strategy: whole documents, whole documents with continuations, or pages that are merged, the first of conflicting values winning."""
    names = [f.name for f in contract.fields]
    if strategy == PAGINATE:
        return merge.settled(extracted_by_page(pages, backend, contract, key, page, content), [key], names)
    if strategy not in (FORBIDDEN, CONCATENATE):
        raise ValueError(f"no such strategy: {strategy}")
    whole = joined(pages, key, page, content)
    return extracted(whole, continued(backend) if strategy == CONCATENATE else backend, contract, key)


def classified(docs: DataFrame, backend: Backend, key: str, content: str = "content") -> DataFrame:
    """(key, name, confidence, error) with the confidence within 1 to 10, else null."""
    a = asked(docs.select(key, F.col(content).alias("prompt")), backend)
    r = F.from_json(X.thinking_json(F.col("raw")), "name string, confidence int")
    return a.select(key, r["name"].alias("name"), F.when(r["confidence"].between(1, 10), r["confidence"]).alias("confidence"), "error")


def matched_classes(docs: DataFrame, backend: Backend, classes: list[tuple[str, str, T.StructType | None]], key: str, content: str = "content") -> DataFrame:
    """(key, name, confidence, error, matched, class_ord, status): one call a document, told of all classes, and the class that its answer names."""
    from sheaf.operators import classify, prompts

    told = docs.select(key, F.concat(F.lit(prompts.classification_prompt(classes) + "\n\n"), prompts.prompt_text(F.col(content))).alias(content))
    names = docs.sparkSession.createDataFrame([(c[0], k) for k, c in enumerate(classes)], "class_name string, ord int")
    return classify.matched(classified(told, backend, key, content), names)


def resolve_conflicts(merged: DataFrame, pages: DataFrame, backend: Backend, key: str, fields: list[str], page: str = "page_no", content: str = "content") -> DataFrame:
    """Merged results whose conflicts a model settles: it is asked once a document that has any, and answers {field: {value, confidence}}. Without an answer the first candidate stays."""
    from sheaf.operators import prompts

    open_ = merge.in_conflict(merged, [key], fields)
    asked_ = asked(prompts.conflict_prompt(open_, pages, key, page, content), backend)
    told = F.from_json(X.thinking_json(F.col("raw")), "map<string,struct<value:string,confidence:double>>")
    answers = asked_.select(key, F.explode(told).alias("field", "a")).select(key, "field", F.col("a.value").alias("value")).where("value is not null")
    return merge.resolved(merged, answers, [key], fields)


def extracted_by_chunk(docs: DataFrame, backend: Backend, contract: T.StructType, key: str, most: int, content: str = "content") -> DataFrame:
    """(key, fields): the text is packed into chunks of ``most`` tokens, each is asked about, and the first value of each field that isn't null wins; lists are joined."""
    from sheaf.operators import pages as P

    parts = P.chunks(docs.select(F.col(key).alias("doc_id"), F.col(content).alias("text")), most)
    relaxed = schema.relaxed(contract)
    a = asked(parts.select("doc_id", "chunk_no", F.concat(F.lit("##Content\n\n"), F.col("content")).alias("prompt")), backend)
    rows = a.select("doc_id", "chunk_no", schema.read(X.thinking_json(F.col("raw")), relaxed)["parsed"].alias("p")).select("doc_id", "chunk_no", "p.*")
    lists = tuple(f.name for f in contract.fields if isinstance(f.dataType, T.ArrayType))
    return merge.first_wins(rows, ["doc_id"], "chunk_no", [f.name for f in contract.fields if f.name not in lists], lists).withColumnRenamed("doc_id", key)


def as_markdown(pages: DataFrame, backend: Backend, key: str, page: str = "page_no", content: str = "content", image: str | None = None) -> DataFrame:
    """(key, page, markdown): every page rewritten by one call; a page that failed is a comment that says why."""
    from sheaf.operators import prompts

    ask = pages.select(key, page, F.concat(F.lit("Rewrite this page as Markdown.\n\n"), F.col(content)).alias("prompt"), (F.col(image) if image else F.lit(None).cast("binary")).alias("picture"))
    a = asked(ask, backend)
    return a.select(key, page, prompts.markdown_page(F.col("raw"), F.col("picture"), F.col("error"), F.col(page)).alias("markdown"))


def cached(prompts: DataFrame, cache: DataFrame, key: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(answered, to be asked): by the prompt's hash, against a table of (prompt_hash, raw, error, input_tokens, output_tokens)."""
    p = prompts.withColumn("prompt_hash", F.sha2(key, 256))
    return p.join(cache, "prompt_hash"), p.join(cache.select("prompt_hash"), "prompt_hash", "left_anti").drop("prompt_hash")


def hooked(frame: DataFrame, *hooks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Interceptors: each sees and may change the frame."""
    for h in hooks:
        frame = frame.transform(h)
    return frame


def model_is(model: Column, names: tuple[str, ...]) -> Column:
    return F.lower(model).isin(*names)
