"""The page operators on streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheaf.functions.text import token_count


def token_windows(events: DataFrame, time: str = "ts", text: str = "text", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, texts, tokens) a window; what comes later than ``late`` is dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("texts"), F.sum(token_count(F.col(text))).alias("tokens")).select("w.start", "w.end", "texts", "tokens")


def fresh(sources: DataFrame, keys: list[str], time: str = "ts", ttl: str = "300 seconds") -> DataFrame:
    """A source that was loaded within ``ttl`` isn't loaded again: the streaming form of a cache with a time to live."""
    return sources.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def split_stream(pages: DataFrame, doc: str, ends: str, idle_ms: int = 60_000) -> DataFrame:
    """(document, group_no, pages): a group is given out when the next one begins, or when nothing comes for ``idle_ms``.

    Pages of a document must come in order; ``ends`` is a boolean column that is true where a page begins a group. The state is one open group.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({doc: [key[0]], "group_no": [number], "pages": [held]})
            return
        for f in frames:
            for page, begins in zip(f.sort_values("page_no")["page_no"], f.sort_values("page_no")[ends], strict=True):
                if begins or not number:
                    if held:
                        out.append((key[0], number, held))
                    number, held = number + 1, []
                held.append(int(page))
        state.update((number, held))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[doc, "group_no", "pages"])

    rows = pages.select(doc, "page_no", ends)
    return rows.groupBy(doc).applyInPandasWithState(step, f"{doc} long, group_no int, pages array<int>", "number int, held array<int>", "append", GroupStateTimeout.ProcessingTimeTimeout)
