"""Words of whole Arrow string columns as numpy arrays: no Python loop over words or characters."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_rng = np.random.default_rng(0x5EAF)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes that are not white space; bytes of words if punctuation separates (letters, digits, all above 127).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_pow["up"]) < n:
        size = max(n, 1 << 16)
        for k, x in (("up", _BASE), ("down", _INV)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow["up"][:n], _pow["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: byte ranges into ``raw``, 64-bit hashes, and the first word of each document."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # documents + 1
    byte_first: np.ndarray  # documents + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its offsets from 0; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


Batches = Iterator[pa.RecordBatch]
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``; what it has freed goes back to the system when a task ends, as workers live on for other tasks.

    Batches are bounded by bytes, not only by rows: very long texts would make them, and their copies in the JVM, as long. A session that was begun with a bound keeps it.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one document is never cut."""
    if not len(column):
        return
    _, o = raw_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
        yield at, min(to, len(column))
        at = min(to, len(column))


def words(column: pa.Array, table: np.ndarray = ALNUM) -> Words:
    """Maximal runs of the bytes that ``table`` admits, hashed by a polynomial over their bytes."""
    raw, o = raw_bytes(column)
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(raw, z, z, np.zeros(0, np.uint64), np.zeros(len(o), np.int64), o)
    inside = table[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = o[:-1][o[:-1] < n]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    stop = o[1:][o[1:] > 0] - 1
    after[stop] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[raw] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(raw, start, end, h, np.searchsorted(start, o), o)


def byte_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over bytes, and the powers that bring a difference of two of them to the start."""
    up, down = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each document, and the first of each (documents + 1). Fewer words than n make one n-gram."""
    c = w.counts()
    m = np.where(c >= n, c - n + 1, (c > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(m)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) - np.repeat(first[:-1], m) + np.repeat(w.first[:-1], m)
    last = np.repeat(w.first[1:], m)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        here = at + k
        ok = here < last
        term = w.hash[np.minimum(here, len(w.hash) - 1)]
        h = h * np.uint64(0xD1342543DE82EF95) + np.where(ok, term, np.uint64(k + 1))
    return mix(h), first
