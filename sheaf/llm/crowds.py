"""Numbers of links within groups of any size, exactly, from a distance that obeys the triangle inequality.

A group of a few blocks is compared pair by pair. In a larger one all members are compared with a pivot: two members near the pivot are linked, and one
near and one far from it are not, without being compared. Only pairs that this leaves open are, in blocks of bounded size; members far from
the pivot go on to the next one, and after some rounds are compared block by block. So a group of any number of near copies takes a few comparisons a member.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import storage
from sheaf.llm.storage import roots
from sheaf.llm.textops import lean

GRID = 1024  # cells of the distance, which goes from 0 to 1
PIVOTS = 8  # candidates for the pivot of a group
FEW = 4  # blocks of a group whose pairs are all compared: a pivot would save little
UNIT = ["group", "left", "right"]
COLUMNS = ["id", *UNIT, "side", "node", "s1", "cell", "need"]
LINKED = "node long, links long, root long"
DISTANCES = "node long, ds array<double>"


@dataclass(frozen=True)
class Metric:
    """How members are compared. ``attach`` adds to units (``COLUMNS``) what is compared, and brings a unit to one place, sorted; ``compare`` maps its rows
    to ``LINKED``, ``measure`` those of pivots and members to ``DISTANCES``. Members within ``limit`` of each other are linked."""

    attach: Callable[[DataFrame], DataFrame]
    compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    measure: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    limit: float


def gathered(rows: DataFrame, *more: str) -> DataFrame:
    """A unit in one place."""
    return rows.select(*UNIT, "side", "node", "s1", "cell", "need", *more).repartition(*UNIT).sortWithinPartitions(*UNIT)


def linked(node: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
    """``LINKED`` of a unit from its matrix of links."""
    x, y = np.nonzero(ok)
    root = node[roots(x, y, len(node))]
    links = ok.sum(1)
    has = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has].astype(np.int64)), pa.array(root[has])], names=["node", "links", "root"])


def measured(node: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """``DISTANCES`` of a unit."""
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * PIVOTS), pa.array(d.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(node), lists], names=["node", "ds"])


def asked(node: np.ndarray, side: np.ndarray, cell: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs of a unit are to be compared: all of one block, those between two; of a block of a ball and one of the rest those that the pivot leaves open."""
    ok = node[:, None] != node[None, :]
    if side.any():
        ok &= side[:, None] != side[None, :]
        if need.any():  # members of the ball have cells, the others the least cell from which a pair is open
            open_ = cell[:, None] >= need[None, :]
            ok &= np.where(side[:, None] == 0, open_, open_.T)
    return ok


def units(work: Callable[[pa.Table], pa.RecordBatch]):
    """Applies ``work`` to the rows of each unit, which come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for b in batches:
            k = np.stack([b[c].to_numpy() for c in UNIT])
            cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if lo == hi:
                    continue
                now = tuple(k[:, lo])
                if now != key and parts:
                    yield work(pa.Table.from_batches(parts).combine_chunks())
                    parts = []
                key = now
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield work(pa.Table.from_batches(parts).combine_chunks())

    return run


def _spread(member: DataFrame, block_docs: int, block_bytes: int, keep: list[str]) -> DataFrame:
    """``member`` with ``blocks``, how many its group is cut into, and its own ``block``, by hash."""
    size = member.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    size = size.select("group", F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("bytes") / block_bytes)).alias("blocks"))
    size = storage.stash(size, keep)
    return member.join(storage.hinted(size, size.count(), 16), "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))


def _all_pairs(member: DataFrame) -> DataFrame:
    """Units of all pairs of blocks of each group."""
    u = member.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return u.select("id", "group", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), F.when(F.col("block") > F.col("with"), 1).otherwise(0).alias("side"), "node", "s1", F.lit(0).alias("cell"), F.lit(0).alias("need"))


def _pivot_round(member: DataFrame, metric: Metric, block_docs: int, block_bytes: int, turn: int, keep: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """A pivot in each group, of some candidates the one with most members near: (members far from it, results for the others and for pairs across)."""
    number = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(PIVOTS)).cast("int")
    few = member.groupBy("group", number.alias("cell")).agg(F.min(F.struct("node", "id", "s1")).alias("p")).select("group", "cell", "p.*")
    few = storage.stash(few, keep)
    zero = lambda d, side: d.select("id", "group", F.col("block").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(side).alias("side"), "node", "s1", "cell", F.lit(0).alias("need")).select(*COLUMNS)
    blocks = member.select("group", "block").distinct()
    units = zero(member.withColumn("cell", F.lit(0)), 0).union(zero(few.join(storage.shuffled(blocks), "group"), 1))
    d = storage.stash(member.drop("blocks", "block").join(storage.shuffled(metric.attach(units).mapInArrow(lean(metric.measure), DISTANCES)), "node"), keep)
    top = math.floor(GRID * metric.limit + 1e-9)
    cell = lambda x: F.ceil(x * GRID - 1e-9).cast("int")
    near = d.groupBy("group").agg(F.array(*[F.sum((cell(F.col("ds")[k]) * 2 <= top).cast("int")) for k in range(PIVOTS)]).alias("near"))
    best = near.select("group", (F.array_position("near", F.array_max("near")) - 1).cast("int").alias("best"))
    count = best.count()
    best = storage.hinted(storage.stash(best, keep), count, 16)
    pivot = few.join(best, (few["group"] == best["group"]) & (few["cell"] == best["best"])).select(few["group"], "node")
    m = d.join(best, "group").withColumn("d", F.col("ds")[F.col("best")]).withColumn("up", cell(F.col("d"))).withColumn("down", F.floor(F.col("d") * GRID + 1e-9).cast("int"))
    m = storage.stash(m.withColumn("ball", F.col("up") * 2 <= top).withColumn("need", F.greatest(F.lit(top + 1) - F.col("up"), F.col("down") - top)).drop("ds"), keep)
    ball, rest = m.where("ball"), m.where("not ball")
    # how many of the ball, and of the rest, are in each cell: at most GRID numbers a group
    cells = lambda x: F.map_from_entries(F.collect_list(F.struct("up", "n"))).alias(x)
    hist = lambda frame, x: frame.groupBy("group", "up").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(cells(x))
    hb, hr = (storage.hinted(hist(f, x), count, 8 * GRID) for f, x in ((ball, "hb"), (rest, "hr")))
    within = lambda h, limit: F.aggregate(F.filter(F.map_entries(h), lambda e: e["key"] <= limit), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    of_group = F.col("group")
    p = pivot.select(of_group, F.col("node").alias("root"))
    inside = ball.join(hb, "group").join(hr, "group", "left").join(storage.hinted(p, count, 16), "group")
    sure_b = within(F.col("hb"), F.lit(GRID)) - 1 + F.coalesce(within(F.col("hr"), F.lit(top) - F.col("up")), F.lit(0))
    out = [inside.select("node", sure_b.alias("links"), "root")]
    across = rest.join(hb, "group").join(storage.hinted(p, count, 16), "group").select("node", within(F.col("hb"), F.lit(top) - F.col("up")).alias("links"), "root")
    out.append(across.where("links > 0"))
    # pairs left open: the ball's cells against those of the rest that ask for them
    cut = lambda frame, c: storage.hinted(frame.groupBy("group", c).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("size") / block_bytes)).alias("k")), count * GRID, 24)
    x = ball.join(cut(ball, "up"), ["group", "up"]).withColumn("part", F.pmod(F.xxhash64("node"), "k"))
    y = rest.where(F.col("need") * 2 <= top).join(cut(rest, "need"), ["group", "need"]).withColumn("part", F.pmod(F.xxhash64("node"), "k"))
    x = storage.stash(x.select("group", "id", "node", "s1", F.col("up").alias("cell"), (F.col("up") * (1 << 32) + F.col("part")).alias("b")), keep)
    y = storage.stash(y.select("group", "id", "node", "s1", "need", (F.col("need") * (1 << 32) + F.col("part")).alias("b")), keep)
    bx, by = x.select("group", F.col("b").alias("left"), "cell").distinct(), y.select("group", F.col("b").alias("right"), "need").distinct()
    both = storage.stash(bx.join(storage.shuffled(by), "group").where("cell >= need").select("group", "left", "right"), keep)
    if both.limit(1).count():
        ux = x.join(storage.shuffled(both), (x["group"] == both["group"]) & (x["b"] == both["left"])).select(x["id"], x["group"], "left", "right", F.lit(0).alias("side"), "node", "s1", "cell", F.lit(0).alias("need"))
        uy = y.join(storage.shuffled(both), (y["group"] == both["group"]) & (y["b"] == both["right"])).select(y["id"], y["group"], "left", "right", F.lit(1).alias("side"), "node", "s1", F.lit(0).alias("cell"), "need")
        out.append(metric.attach(ux.union(uy)).mapInArrow(lean(metric.compare), LINKED))
    return rest.select(*[c for c in member.columns if c not in ("blocks", "block")]), [storage.stash(o, keep) for o in out]


def verified(items: DataFrame, metric: Metric, block_docs: int, block_bytes: int, rounds: int, keep: list[str]) -> DataFrame:
    """(node, links, root): exact numbers of links of the items (node, id, s1, size, group) within their groups, and links that span the groups."""
    done = None
    member = items
    for turn in range(rounds + 1):
        member = storage.stash(_spread(member, block_docs, block_bytes, keep), keep)
        large = member.where(F.col("blocks") > FEW)
        last = turn == rounds or not large.limit(1).count()
        flat = member if last else member.where(F.col("blocks") <= FEW)
        part = [storage.stash(metric.attach(_all_pairs(flat)).mapInArrow(lean(metric.compare), LINKED), keep)]
        if not last:
            member, more = _pivot_round(large, metric, block_docs, block_bytes, turn, keep)
            part += more
        for p in part:
            done = p if done is None else done.union(p)
        if last:
            return done


def placed(nodes: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    """``nodes`` (node, id and others) with class_id, the least id of what links connect, and the number of links."""
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = storage.connected_components(found.select("node", "root"), "node", "root")
    put = storage.stash(nodes.join(storage.shuffled(parts), "node", "left").join(storage.shuffled(total), "node", "left"), keep)
    first = put.where("component is not null").groupBy("component").agg(F.min("id").alias("class_id"))
    # nodes without links have no part: keys of their own keep them from meeting in one task
    part = F.coalesce(put["component"], -1 - F.col("node"))
    return put.withColumn("part", part).join(storage.shuffled(first.withColumnRenamed("component", "part")), "part", "left").withColumn("class_id", F.coalesce("class_id", "id")).withColumn("links", F.coalesce("links", F.lit(0)))
