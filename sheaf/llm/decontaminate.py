"""Benchmark decontamination by latent semantic retrieval.

All documents are cut into passages of ``PASSAGE`` words, weighted by TF-IDF over ``TERMS`` hashed terms. A
randomised SVD finds the latent space: each passage is added with a random sign to one of ``SKETCH`` rows, the sums of all
partitions are added up, and the right singular vectors of that small matrix are those of the corpus, nearly. Texts are
mapped by them, scaled by the inverse singular values. Every window of every document that shares enough words with an item
of its length, in any order, is a candidate. Candidates are checked by longest common subsequence, as a whole and on the
item's answer (what follows its last inner sentence end, or else its last third), those nearest by cosine in the latent
space first; later ones are passed over only where their shared words show that they can't be better. The cosine
drops nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import storage
from sheaf.llm.tables import id_and_text
from sheaf.llm.textops import Words, lean, mix, slices, words

TERMS, PASSAGE, SKETCH, RANK, BLOCK, CHUNK = 16384, 48, 96, 64, 16, 256


def _terms(w: Words) -> np.ndarray:
    return (w.hash >> np.uint64(50)).astype(np.int64)


def _passages(w: Words) -> np.ndarray:
    """The passage of each word, counted through all documents of the slice."""
    count = -(-w.counts() // PASSAGE)
    first = np.cumsum(count) - count
    doc = w.doc()
    return first[doc] + (np.arange(len(doc)) - w.first[doc]) // PASSAGE


def _df_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(TERMS + 1, np.int64)  # the last counts passages
    for b in batches:
        for lo, hi in slices(b["text"]):
            w = words(pc.utf8_lower(b["text"].slice(lo, hi - lo)))
            if len(w.hash):
                p = _passages(w)
                key = np.sort((p.astype(np.uint64) << np.uint64(14)) | _terms(w).astype(np.uint64))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                df[:TERMS] += np.bincount((key & np.uint64(TERMS - 1)).astype(np.int64), minlength=TERMS)
                df[TERMS] += p[-1] + 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])


def _sketch_rows(idf: np.ndarray):
    """Sums of passages with random signs in random rows; of one partition, one message a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH * TERMS)
        for b in batches:
            for lo, hi in slices(b["text"]):
                w = words(pc.utf8_lower(b["text"].slice(lo, hi - lo)))
                if not len(w.hash):
                    continue
                p, t = _passages(w), _terms(w)
                start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                weight = idf[t]
                norm = np.sqrt(np.add.reduceat(weight * weight, start))
                # row and sign come from the passage's words, so they don't depend on the partition
                h = mix(np.add.reduceat(w.hash * ((np.arange(len(t)) - start[p]).astype(np.uint64) * np.uint64(2) + np.uint64(1)), start))
                row = (h % np.uint64(SKETCH)).astype(np.int64)
                sign = np.where(h >> np.uint64(63), 1.0, -1.0) / np.maximum(norm, 1e-9)
                total += np.bincount(row[p] * TERMS + t, weights=weight * sign[p], minlength=SKETCH * TERMS)
        total = total.reshape(SKETCH, TERMS).astype(np.float32)
        for r in np.flatnonzero(total.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(r)], pa.int32()), pa.array([total[r].tobytes()], pa.binary())], names=["row", "v"])

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for r, v in zip(b["row"].to_pylist(), b["v"], strict=True):
            x = np.frombuffer(v.as_buffer(), np.float32).astype(np.float64)
            sums[r] = sums[r] + x if r in sums else x
    for r, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["row", "v"])


def latent_space(docs: DataFrame) -> np.ndarray:
    """(TERMS, RANK) map of term counts into the latent space, of (id, text) rows. Without any words it is all zeros."""
    df = np.zeros(TERMS + 1)
    for r in docs.mapInArrow(lean(_df_rows), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    idf = np.log((1 + df[TERMS]) / (1 + df[:TERMS])) + 1e-3
    rows = docs.mapInArrow(lean(_sketch_rows(idf)), "row int, v binary").repartition("row").mapInArrow(lean(_add_rows), "row int, v binary").collect()
    b = np.zeros((SKETCH, TERMS))
    for r in rows:
        b[r["row"]] = np.frombuffer(r["v"], np.float64)
    if not b.any():
        return np.zeros((TERMS, RANK), np.float32)
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    s, vt = s[:RANK], vt[:RANK]
    return (idf[:, None] * (vt / np.maximum(s, s[0] * 1e-6)[:, None]).T).astype(np.float32)


@dataclass(frozen=True)
class Item:
    id: int
    hashes: tuple[int, ...]
    answer: int  # where the answer begins


def _item_words(text: str) -> list[int]:
    return words(pc.utf8_lower(pa.array([text]))).hash.tolist()


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[Item]:
    """The items with at least one word and an id; of one id with several texts all are used."""
    rows = benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[text_col].alias("t")).where("i is not null and t is not null").distinct().collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["i"], r["t"])):
        h = _item_words(r["t"])
        if not h:
            continue
        ends = [m.end() for m in re.finditer(r"[.!?\n]", r["t"].rstrip(" \n.!?"))]
        before = len(_item_words(r["t"][: ends[-1]])) if ends else 0
        answer = before if 0 < before <= len(h) - 3 else len(h) - max(1, len(h) // 3)
        out.append(Item(r["i"], tuple(h), min(answer, len(h) - 1)))
    return out


def common_subsequence(a: tuple[int, ...] | list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := masks.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judged(item: Item, window: list[int], whole: float, part: float, answer: float) -> tuple[int, int] | None:
    """(common words, common words of the answer) if the window holds the item or a paraphrase of it."""
    n = len(item.hashes)
    have = set(window)
    if sum(x in have for x in item.hashes) < part * n:
        return None
    k = common_subsequence(item.hashes, window)
    a = common_subsequence(item.hashes[item.answer :], window)
    size = n - item.answer
    least = whole * n if n >= 8 else n  # a few words prove nothing unless all are there
    return (k, a) if k >= least or (n >= 8 and k >= part * n and a >= answer * size) else None


def _blocks(x: np.ndarray) -> np.ndarray:
    """Sums of each BLOCK rows."""
    while len(x) and x.shape[1] > 1:
        x = x[:, 0::2] + x[:, 1::2]
    return x[:, 0] if len(x) else x.reshape(0, x.shape[-1])


class _Chunk:
    """Some items of one length class, with the words they hold."""

    def __init__(self, items: list[Item], vectors: np.ndarray, least: float) -> None:
        self.items, self.vectors = items, vectors
        self.words, number = np.unique(np.concatenate([np.array(it.hashes, np.uint64) for it in items]), return_inverse=True)
        owner = np.repeat(np.arange(len(items)), [len(it.hashes) for it in items])
        self.times = np.zeros((len(items), len(self.words) + 1), np.uint16)  # how often each item holds each word; the last is no word
        np.add.at(self.times, (owner, number), 1)
        self.holds = np.ascontiguousarray((self.times > 0).T.astype(np.uint8))
        self.need = np.array([math.ceil(least * len(it.hashes) - 1e-9) for it in items])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def shared(self, rows: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Size of the multiset intersection of each row of word numbers with its item: no common subsequence is longer."""
        rows = np.sort(rows, axis=1)
        place = np.arange(rows.shape[1])
        new = np.ones(rows.shape, bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        rank = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
        return (rank < self.times[item[:, None], rows]).sum(1)


def _search(space: np.ndarray, items: list[Item], cosine: float | None, whole: float, part: float, answer: float):
    space = np.vstack([space, np.zeros((1, space.shape[1]), np.float32)])
    by_width: dict[int, list[int]] = {}
    for i, it in enumerate(items):
        by_width.setdefault(-(-len(it.hashes) // BLOCK) + 1, []).append(i)
    vectors = np.stack([space[np.array(it.hashes, np.uint64) >> np.uint64(50)].sum(0) for it in items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    classes = {w: [_Chunk([items[i] for i in own[k : k + CHUNK]], vectors[own[k : k + CHUNK]], min(whole, part)) for k in range(0, len(own), CHUNK)] for w, own in by_width.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["id"].to_numpy()
            found: dict[tuple[int, int], tuple[int, int, float]] = {}
            for lo, hi in slices(b["text"], 1 << 18):
                w = words(pc.utf8_lower(b["text"].slice(lo, hi - lo)))
                if not len(w.hash):
                    continue
                count = -(-w.counts() // BLOCK)
                first = np.concatenate([[0], np.cumsum(count)])
                doc = w.doc()
                place = first[doc] * BLOCK + np.arange(len(doc)) - w.first[doc]
                padded = np.full(first[-1] * BLOCK, TERMS)
                padded[place] = _terms(w)
                sums = _blocks(np.take(space, padded, axis=0).reshape(-1, BLOCK, space.shape[1]))
                owner = np.repeat(np.arange(len(count)), count)
                for width, chunks in classes.items():
                    inside = [owner[k:] == owner[:-k] for k in range(1, width)]
                    win = _over_blocks(sums, inside)
                    # a window that runs past the end of a document with a longer one before it adds nothing
                    win /= np.maximum(np.sqrt(np.einsum("ij,ij->i", win, win)), 1e-12)[:, None]
                    for c in chunks:
                        number = np.full(first[-1] * BLOCK, len(c.words))
                        number[place] = c.numbers(w.hash)
                        number = number.reshape(-1, BLOCK)
                        many = _over_blocks(_blocks(np.take(c.holds, number.ravel(), axis=0).reshape(-1, BLOCK, len(c.items))).astype(np.uint16), inside)
                        xs, ys = np.nonzero(many >= c.need)
                        near = np.einsum("ij,ij->i", win[xs], c.vectors[ys])
                        order = np.argsort(-near, kind="stable")
                        if cosine is not None:
                            order = order[near[order] >= cosine]
                        xs, ys = xs[order], ys[order]
                        for at in range(0, len(xs), 1 << 14):
                            x, y = xs[at : at + (1 << 14)], ys[at : at + (1 << 14)]
                            spot = x[:, None] + np.arange(width)
                            good = spot < len(owner)
                            spot = np.minimum(spot, len(owner) - 1)
                            good &= owner[spot] == owner[x][:, None]
                            rows = np.where(good[:, :, None], number[spot], len(c.words)).reshape(len(x), -1)
                            most = c.shared(rows, y)
                            keep = most >= c.need[y]
                            for x1, y1, most1 in zip(x[keep].tolist(), y[keep].tolist(), most[keep].tolist(), strict=True):
                                d = owner[x1]
                                begin = w.first[d] + (x1 - first[d]) * BLOCK
                                it = c.items[y1]
                                key = (int(ids[lo + d]), it.id)
                                if key in found and most1 < found[key][0]:
                                    continue
                                if got := judged(it, w.hash[begin : min(begin + width * BLOCK, w.first[d + 1])].tolist(), whole, part, answer):
                                    best = (*got, len(it.hashes))
                                    if key not in found or best > found[key]:
                                        found[key] = best
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([found[k][c] for k in keys], pa.int32()) for c in range(3))],
                    names=["id", "item_id", "common_words", "answer_words", "item_words"],
                )

    return run


def _over_blocks(sums: np.ndarray, inside: list[np.ndarray]) -> np.ndarray:
    """Of each block the sum of it and those after it in the same document, as many as a window has."""
    out = sums.copy()
    for k, same in enumerate(inside, 1):
        out[: len(same)] += sums[k:] * same[:, None].astype(sums.dtype)
    return out


_FOUND = "id long, item_id long, common_words int, answer_words int, item_words int"


def leaks(docs: DataFrame, benchmark: DataFrame, *, cosine: float | None = None, whole: float = 0.8, part: float = 0.6, answer: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, common_words, answer_words, item_words): documents that hold a benchmark item or a paraphrase of it.

    A window counts if it shares, in order, ``whole`` of the item's words, or ``part`` of them and ``answer`` of the words of
    the answer; of an item under 8 words all. With a ``cosine``, only windows that near in the latent space count; that loses
    some that hold an item, so none is set by default. A row tells the best window of a document for an item. Null and empty texts and items, and rows without an id,
    match nothing; rows that repeat an id give one result. Texts are searched to their end. An empty table on either side gives an empty
    result; other columns are not read. The items are sent to all executors, in parts of bounded size where they are many.
    """
    d = id_and_text(docs, id_col, text_col)
    items = items_of(benchmark)
    spark = docs.sparkSession
    if not items:
        return spark.createDataFrame([], _FOUND.replace("id long", f"{id_col} long", 1))
    space = latent_space(d)
    out = None
    for part_ in _portions(items):
        hit = d.mapInArrow(lean(_search(space, part_, cosine, whole, part, answer)), _FOUND)
        out = hit if out is None else out.union(hit)
    best = out.groupBy("id", "item_id").agg(F.max(F.struct("common_words", "answer_words", "item_words")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.common_words", "b.answer_words", "b.item_words")


def _portions(items: list[Item], most: int = storage.BROADCAST_BYTES // 2) -> Iterator[list[Item]]:
    part, size = [], 0
    for it in items:
        cost = RANK * 4 + len(it.hashes) * 40
        if part and size + cost > most:
            yield part
            part, size = [], 0
        part.append(it)
        size += cost
    yield part


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw: object) -> DataFrame:
    """``docs`` without the documents that ``leaks`` finds; rows without an id, null and empty texts are kept. Columns stay as they are.

    All rows of an id go if one of them holds an item. An empty table gives an empty result; an empty benchmark removes nothing.
    """
    bad = storage.stash(leaks(docs, benchmark, id_col=id_col, **kw).select(F.col(id_col).alias("leaking")).distinct())
    return docs.join(storage.hinted(bad, bad.count(), 16), docs[id_col].cast("long") == bad["leaking"], "left_anti")
