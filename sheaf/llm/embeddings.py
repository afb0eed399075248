"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its coordinates with a correction factor, the inner product
of the vector and its code. With a second vector, rotated and rounded at random to 4 bits a coordinate, the product of code
and vector over that factor estimates the inner product of the two without bias, and its spread is known from the factor.
Pairs whose upper confidence bound misses the threshold are done with; only the others are recomputed exactly.

Which pairs meet at all is decided by bands of signs under other random projections: as many bits a band as the number of
vectors asks for, and as many bands as the target recall at the threshold asks for. Pairs that the bounds leave in connect candidate groups, and so
does a bucket of far more vectors than expected, as a whole. Within the groups ``crowds`` counts the links by the angle as its distance; there, too, the
bounds decide which pairs are recomputed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import crowds, storage
from sheaf.llm.textops import lean, mix


def rotation(dim: int, seed: int = 9) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs, correction factors, 4-bit coordinates, their lows and steps) of unit vectors; the rounding depends on the ids only."""
    z = unit @ turn.T
    signs = z >= 0
    factor = np.abs(z).sum(1) / math.sqrt(z.shape[1])
    low = z.min(1)
    step = np.maximum((z.max(1) - low) / 15, 1e-12)
    spot = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(z.shape[1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    noise = (mix(spot) >> np.uint64(11)) * 2.0**-53
    levels = np.clip(np.floor((z - low[:, None]) / step[:, None] + noise), 0, 15).astype(np.uint8)
    return signs, factor, levels, low, step


def estimate(signs: np.ndarray, factor: np.ndarray, levels: np.ndarray, low: np.ndarray, step: np.ndarray, x: slice, y: slice, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of the vectors in x with those in y, and the half width of their confidence bounds."""
    dim = signs.shape[1]
    pm = lambda s: (signs[s].astype(np.float32) * 2 - 1) / math.sqrt(dim)
    full = lambda s: (levels[s] * step[s, None] + low[s, None]).astype(np.float32)
    one = (pm(x) @ full(y).T) / factor[x, None]
    two = (full(x) @ pm(y).T) / factor[None, y]
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(dim - 1, 1))) + step / 2 / factor
    return (one + two) / 2, sure * (spread[x, None] + spread[None, y]) / 2


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit coordinates, their lows and steps) of unit vectors."""
    low = unit.min(1)
    step = np.maximum((unit.max(1) - low) / 255, 1e-12)
    return np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8), low, step


def barely(fine: np.ndarray, low: np.ndarray, step: np.ndarray, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the 8-bit vectors in x with those in y, and how far the vectors' own may be from them."""
    full = lambda s: (fine[s] * step[s, None] + low[s, None]).astype(np.float32)
    # a vector is off by half a step a coordinate at most, so by e = step * sqrt(dim) / 2 in length; products by e1 + e2 + e1 * e2, and single precision's share
    off = lambda s: step[s] * math.sqrt(fine.shape[1]) / 2
    e1, e2 = off(x)[:, None], off(y)[None]
    return full(x) @ full(y).T, e1 + e2 + e1 * e2 + 1e-5


def band_plan(count: int, least: float, recall: float, bucket: int = 200) -> tuple[int, int]:
    """(bits a band, bands): buckets of about ``bucket`` vectors, and the recall at the threshold."""
    bits = max(3, math.ceil(math.log2(max(1, count) / bucket))) if count > bucket else 3
    hit = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


_CODE = "signs binary, levels binary, factor double, low double, step double"
_CODES = [x.split()[0] for x in _CODE.split(", ")]
_FINE = "fine binary, fine_low double, fine_step double"
_FINES = [x.split()[0] for x in _FINE.split(", ")]


def _code_rows(dim: int):
    """The code of each vector beside it."""
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b["v"])
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            signs, factor, levels, low, step = encode(unit, turn, b["node"].to_numpy())
            fine, fine_low, fine_step = rounded(unit)
            packed = [r.tobytes() for r in np.packbits(signs, axis=1)]
            four = [r.tobytes() for r in (np.pad(levels, ((0, 0), (0, dim % 2)))[:, 0::2] << 4 | np.pad(levels, ((0, 0), (0, dim % 2)))[:, 1::2])]
            yield pa.RecordBatch.from_arrays([b["node"], b["id"], b["v"], pa.array(packed, pa.binary()), pa.array(four, pa.binary()), pa.array(factor), pa.array(low), pa.array(step), pa.array([r.tobytes() for r in fine], pa.binary()), pa.array(fine_low), pa.array(fine_step)], names=["node", "id", "v", *_CODES, *_FINES])

    return run


def _band_rows(dim: int, bits: int, bands: int, codes: bool):
    """One row a band: the bucket, and with ``codes`` what the estimates need."""
    planes = np.random.default_rng(99).standard_normal((bands * bits, dim))
    more = [*_CODES, *_FINES] if codes else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            side = (_matrix(b["v"]) @ planes.T >= 0).reshape(b.num_rows, bands, bits)
            key = (side * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(2)
            for k in range(bands):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, k, np.int32)), pa.array(key[:, k]), b["node"], *(b[c] for c in more)], names=["band", "bucket", "node", *more])

    return run


def _codes_of(t: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    stacked = lambda c: np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    signs = np.unpackbits(stacked("signs"), axis=1)[:, :dim].astype(bool)
    four = stacked("levels")
    levels = np.stack([four >> 4, four & 15], axis=2).reshape(t.num_rows, -1)[:, :dim]
    return signs, t["factor"].to_numpy(), levels, t["low"].to_numpy(), t["step"].to_numpy()


def _bucket_links(dim: int, least: float, sure: float, block: int = 1024):
    """(a, b): links that span what the bounds leave in of a bucket; of each two blocks of it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        node, code = t["node"].to_numpy(), _codes_of(t, dim)
        fine = np.frombuffer(b"".join(t["fine"].to_pylist()), np.uint8).reshape(t.num_rows, -1), t["fine_low"].to_numpy(), t["fine_step"].to_numpy()
        for i in range(0, len(node), block):
            for j in range(i, len(node), block):
                mean, half = estimate(*code, slice(i, i + block), slice(j, j + block), sure)
                open_ = mean + half >= least
                if open_.any():
                    mean, half = barely(*fine, slice(i, i + block), slice(j, j + block))
                    open_ &= mean + half >= least
                x, y = np.nonzero(open_)
                own = np.unique(np.concatenate([x + i, y + j]))
                root = own[crowds.roots(np.searchsorted(own, x + i), np.searchsorted(own, y + j), len(own))]
                far = root != own
                if far.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[own[far]]), pa.array(node[root[far]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for b in batches:
            k = np.stack([b["band"].to_numpy().astype(np.int64), b["bucket"].to_numpy()])
            cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if tuple(k[:, lo]) != key and parts:
                    yield from links(pa.Table.from_batches(parts).combine_chunks())
                    parts = []
                key = tuple(k[:, lo])
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield from links(pa.Table.from_batches(parts).combine_chunks())

    return run


def _comparer(dim: int, least: float, sure: float):
    def work(t: pa.Table) -> pa.RecordBatch:
        node, side, cell, need = (t[c].to_numpy() for c in ("node", "side", "cell", "need"))
        mean, half = estimate(*_codes_of(t, dim), slice(None), slice(None), sure)
        open_ = (mean + half >= least) & crowds.asked(node, side, cell, need)
        x, y = np.nonzero(open_)
        v = np.concatenate([_matrix(c) for c in t["v"].chunks])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for lo in range(0, len(x), 1 << 16):
            i, j = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
            open_[i, j] = (v[i] * v[j]).sum(1) >= least
        return crowds.linked(node, open_ | open_.T)

    return crowds.units(work)


def _angles():
    """Angles from the pivots as shares of a half turn."""

    def work(t: pa.Table) -> pa.RecordBatch:
        v = np.concatenate([_matrix(c) for c in t["v"].chunks])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        side = t["side"].to_numpy()
        pivot, rest = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        d = np.ones((len(rest), crowds.PIVOTS))
        d[:, t["cell"].to_numpy()[pivot]] = np.arccos(np.clip(v[rest] @ v[pivot].T, -1, 1)) / np.pi
        return crowds.measured(t["node"].to_numpy()[rest], d)

    return crowds.units(work)


def vector_classes(
    table: DataFrame, *, least: float = 0.95, recall: float = 0.999, sure: float = 4.0, crowd: int = 1 << 14, block: int = 512, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, class_id, links) of the rows with an id and a vector.

    Two vectors are linked if their cosine, exactly computed, is ``least`` or more. ``links`` is the number of other vectors, apart from equal ones, that the
    row's is linked with; ``class_id`` the least id of all rows that links and equal vectors connect it to.
    Left out are rows without an id, and vectors that are null, zero, hold a null or no number, or have another length than most (of
    equally frequent lengths the least). Rows that repeat an id and vector count once; an id with different vectors has a row for each class and number of links.
    ``sure`` is the half width of the confidence bounds in standard deviations. An empty table gives an empty result; other columns are not read.
    """
    spark = table.sparkSession
    keep: list[str] = []
    v = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: x != 0)
    v = v.where(fine)
    most = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return spark.createDataFrame([], f"{id_col} long, class_id long, links long")
    dim = most["dim"]
    v = v.where(F.size("v") == dim).withColumn("key", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    one = storage.stash(v.groupBy("key").agg(F.min("id").alias("id"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), keep)
    nodes = storage.stash(one.select("node", "id", "v").mapInArrow(lean(_code_rows(dim)), f"node long, id long, v array<double>, {_CODE}, {_FINE}"), keep)
    bits, bands = band_plan(nodes.count(), least, recall)
    spots = nodes.select("node", "v").mapInArrow(lean(_band_rows(dim, bits, bands, False)), "band int, bucket long, node long")
    full = storage.stash(spots.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where(F.col("n") > crowd), keep)
    rows = nodes.drop("id").mapInArrow(lean(_band_rows(dim, bits, bands, True)), f"band int, bucket long, node long, {_CODE}, {_FINE}")
    crowded = storage.hinted(full.select("band", "bucket", "first"), full.count(), 24)
    some = rows.join(crowded.drop("first"), ["band", "bucket"], "left_anti").repartition("band", "bucket").sortWithinPartitions("band", "bucket")
    stars = spots.join(crowded, ["band", "bucket"]).select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    groups = storage.connected_components(some.mapInArrow(lean(_bucket_links(dim, least, sure)), "a long, b long").union(stars))
    member = nodes.select("node", F.col("node").alias("id"), F.lit(0).cast("long").alias("s1"), F.lit(dim * 8).alias("size")).join(storage.shuffled(groups.withColumnRenamed("component", "group")), "node")
    code = nodes.drop("id", *_FINES)
    attach = lambda units: crowds.gathered(code.join(storage.hinted(units, units.count(), 72), "node"), "v", *_CODES)
    metric = crowds.Metric(attach, _comparer(dim, least, sure), _angles(), math.acos(min(1.0, least)) / math.pi)
    found = storage.stash(crowds.verified(storage.stash(member, keep), metric, block, block * dim * 16, rounds, keep), keep)
    placed = crowds.placed(one.select("node", "key", "id"), found, keep)
    out = storage.stash(v.select("id", "key").join(storage.shuffled(placed.select("key", "class_id", "links")), "key").select(F.col("id").alias(id_col), "class_id", "links").distinct())
    storage.discard(spark, keep)
    return out
