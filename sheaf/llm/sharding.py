"""Longest-processing-time scheduling of groups onto shards.

Groups of one size are alike to the heap, so it is fed with (size, how many) runs, largest size first, and gives back how many of each run go to which shard. Which
group of a run that is follows from its number within the run. So only the distinct sizes go through one task; groups never do.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import storage
from sheaf.llm.tables import id_and_text
from sheaf.llm.textops import lean

#: Groups of one size are numbered in so many parts, so that no size is too large for a task.
PARTS = 64


def dealt(load: np.ndarray, size: int, many: int) -> np.ndarray:
    """How many of ``many`` groups of one size each shard gets from the heap, and the new loads, in place.

    A heap that deals equal sizes takes the least loads first, ties by shard, and comes to every shard again only when all others have caught up: in each round
    of ``size`` the shards at the least level get one each. All full rounds are dealt at once.
    """
    got = np.zeros(len(load), np.int64)
    if size == 0:
        got[int(np.argmin(load))] = many  # loads don't change, so all go to the first of the least
        return got
    # the k-th group of a shard goes at load + k * size; the heap takes these in order, so it deals all below a level and then some at it
    low, high = int(load.min()), int(load.min()) + size * many
    count = lambda level: np.maximum(0, (level - load + size - 1) // size)  # noqa: E731  # starts strictly below the level
    while low < high:
        middle = (low + high + 1) // 2
        if int(count(middle).sum()) <= many:
            low = middle
        else:
            high = middle - 1
    got = count(low)
    load += got * size
    heap = [(int(x), k) for k, x in enumerate(load)]
    heapq.heapify(heap)
    for _ in range(many - int(got.sum())):  # fewer than there are shards
        x, k = heap[0]
        heapq.heapreplace(heap, (x + size, k))
        load[k] += size
        got[k] += 1
    return got


def order_in_run(load: np.ndarray, size: int, many: int) -> np.ndarray:
    """The shards of ``many`` groups of one size in the order in which the heap gives them, one by one; for tests and small runs."""
    heap = [(int(x), k) for k, x in enumerate(load)]
    heapq.heapify(heap)
    out = np.empty(many, np.int64)
    for i in range(many):
        x, k = heap[0]
        heapq.heapreplace(heap, (x + size, k))
        out[i] = k
    return out


def _assign(shards: int):
    """(size, shard, first, last): the numbers within its run of the groups that a shard gets. Runs come by size, largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(shards, np.int64)
        for b in batches:
            rows: list[list[np.ndarray]] = []
            for size, many in zip(b["size"].to_pylist(), b["many"].to_pylist(), strict=True):
                got = dealt(load, size, many)
                to = np.cumsum(got)
                has = np.flatnonzero(got)
                rows.append([np.full(len(has), size), has, (to - got)[has], to[has]])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64)) for k in range(4)], names=["size", "shard", "first", "last"])

    return run


def schedule(groups: DataFrame, shards: int, keep: list[str] | None = None) -> DataFrame:
    """(part, shard) of (part, size) groups: by size, largest first, each to the shard with the least load so far.

    Groups of one size can be swapped without changing any load; they go in runs, in the order of their hashed numbers, to the shards in theirs. Ties of load go to the
    least shard. A null or negative size counts as 0. An empty table gives an empty result.
    """
    own: list[str] = [] if keep is None else keep
    size = F.greatest(F.coalesce(groups["size"].cast("long"), F.lit(0)), F.lit(0))
    g = storage.stash(groups.select("part", size.alias("size"), F.pmod(F.xxhash64("part"), F.lit(PARTS)).alias("slot")), own)
    counts = storage.stash(g.groupBy("size", "slot").agg(F.count(F.lit(1)).alias("n")), own)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("slot")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("size", "slot").orderBy("part")) - 1
    placed = g.withColumn("k", number).join(before, ["size", "slot"]).select("part", "size", (F.col("before") + F.col("k")).alias("at"))
    runs = counts.groupBy("size").agg(F.sum("n").alias("many")).repartition(1).sortWithinPartitions(F.desc("size"))
    dealt_ = storage.stash(runs.mapInArrow(lean(_assign(shards)), "size long, shard long, first long, last long"), own)
    # a run's shares as one row, so that a group finds its own by its number
    shares = dealt_.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("shares"))
    found = F.element_at(F.filter("shares", lambda x: x["last"] > F.col("at")), 1)["shard"]
    out = placed.join(shares, "size").select("part", found.cast("int").alias("shard"))
    if keep is None:
        out = storage.stash(out)
        storage.discard(groups.sparkSession, own)
    return out


def shard_documents(docs: DataFrame, *, shards: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, shard): documents with the same text stay together, ``part`` being the least id among them.

    A group is as large as the characters of its texts. Null texts count as empty, and all empty ones are one group of
    size 0. Rows without an id are left out; rows that repeat an id each count, and get the shard of their own text. Texts are told
    apart by 256-bit hashes, whole. An empty table gives an empty result; other columns are not read.
    """
    keep: list[str] = []
    d = id_and_text(docs, id_col, text_col).select("id", F.sha2("text", 256).alias("key"), F.length("text").alias("chars"))
    groups = d.groupBy("key").agg(F.min("id").alias("part"), F.sum("chars").alias("size"))
    # ids may repeat with other texts, so groups are numbered by key as well
    placed = schedule(groups.groupBy("part").agg(F.sum("size").alias("size")), shards, keep)
    out = storage.stash(d.select("id", "key").join(groups.select("key", "part"), "key").join(placed, "part").select(F.col("id").alias(id_col), "part", "shard"))
    storage.discard(docs.sparkSession, keep)
    return out
