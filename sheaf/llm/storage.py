"""Durable intermediates, size-checked broadcasts and connected components.

Lineage is cut by writing Parquet under the folder that the session names in
``spark.checkpoint.dir``: every executor can read it, so losing one loses nothing.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.textops import lean

#: A join side is broadcast only if its estimated size is under this: each of a thousand executors gets a copy.
BROADCAST_BYTES = 10 << 20
#: What a row of a broadcast table takes in memory besides its columns: measured, about 230 bytes for a row of two numbers.
ROW_BYTES = 216
#: Edges that are few enough for one task of an executor to connect them.
ALONE = 1 << 20

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, a temporary one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="sheaf-")
    return _local["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``keep`` collects the paths for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sheaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have stopped already
        return


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stashed tables that no later plan reads."""
    while paths:
        _delete(spark, paths.pop())


def small_enough(rows: int, row_bytes: int) -> bool:
    return rows * (row_bytes + ROW_BYTES) <= BROADCAST_BYTES


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that is never broadcast: Spark would estimate it by the bytes of its files, compressed, of which a row in memory takes many times as much."""
    return df.hint("merge")


def hinted(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size allows it; otherwise it is shuffled."""
    return F.broadcast(df) if small_enough(rows, row_bytes) else shuffled(df)


def roots(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """The least member of each one's component, of links between numbers below ``count``."""
    root = np.arange(count)
    while True:
        a, b = root[x], root[y]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return root
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            new = root[root]
            if (new == root).all():
                break
            root = new


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that connect what the edges (two columns) of a partition connect: as many edges as it has nodes, at most."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size, stars = 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        root = roots(at[: len(x)], at[len(x) :], len(nodes))
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[far], nodes[root[far]]

    for b in batches:
        parts.append((b[0].to_numpy(), b[1].to_numpy()))
        size += b.num_rows
        if size > max(1 << 20, 2 * stars):
            parts = [merged()]
            size = stars = len(parts[0][0])
    if size:
        u, v = merged()
        for lo in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + (1 << 16)]), pa.array(v[lo : lo + (1 << 16)])], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", alone: int = ALONE) -> DataFrame:
    """(node, component) of every node of ``edges``; the component is its least node.

    Each partition keeps stars that connect the same nodes as its edges. If at most ``alone`` edges are left, one task connects them; if not,
    alternating large-star and small-star rounds go on until that is so or the edge set is a set of stars. Each round is
    two shuffles of the edges and is written to the shared folder. Nulls and loops are ignored; an
    empty edge set gives an empty result.
    """
    spark = edges.sparkSession
    old: list[str] = []
    now: list[str] = []
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = stash(pairs.mapInArrow(lean(forest), "u long, v long"), now)
    # the least neighbour of each node is aggregated before it is joined, so that no centre of a large star is collected in one place
    def lowest(d: DataFrame) -> DataFrame:
        return d.join(shuffled(d.groupBy("u").agg(F.min("v").alias("least"))), "u").withColumn("m", F.least("u", "least"))

    last, count = None, e.count()
    while count > alone:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = lowest(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new: list[str] = []
        e2 = stash(small, new)
        sign = e2.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(spark, old)
        old, now, e = now, new, e2
        if last == (sign["n"], sign["h"]):
            break
        last, count = (sign["n"], sign["h"]), sign["n"]
    if count <= alone:
        new = []
        e = stash(e.coalesce(1).mapInArrow(lean(forest), "u long, v long"), new)
        old += now
    discard(spark, old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
