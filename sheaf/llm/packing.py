"""Bounded-space online packing of token sequences into windows.

Every partition tokenises its documents as they come and keeps so many windows open at once. A document goes to the open
window that it fills best; if none has room the fullest is emitted when all are open, and a new one begins. What is still open at the end
of a partition is packed in the same way with the leftovers of other partitions, in rounds of fewer buckets down to one. So documents
and tokens are never shuffled, but for those leftovers.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import storage
from sheaf.llm.tables import id_and_text
from sheaf.llm.textops import lean, slices, words

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_loaded: dict[str, Tokens] = {}


class Tokens:
    """Exact tokens of whole texts, word by word.

    The tokenizer's pattern never joins what white space separates, but for one space before a word. So the tokens of a text
    are those of its words, with their space, and of the rest of its white space; they are kept in a pool, found by a 64-bit hash.
    Other white space than ASCII's can join with its neighbours: texts that hold it are encoded as they are.
    """

    SLOTS, POOL = 1 << 19, 1 << 22

    def __init__(self, path: str) -> None:
        import base64

        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pool = np.zeros(1 << 16, np.int32)
        self._empty()

    def _empty(self) -> None:
        self.used = 0
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.start = np.zeros(self.SLOTS, np.int32)
        self.count = np.zeros(self.SLOTS, np.int32)
        self.gaps: dict[bytes, tuple[int, int]] = {}

    @classmethod
    def at(cls, path: str) -> Tokens:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _put(self, ids: list[int]) -> tuple[int, int]:
        """Where the tokens are in the pool now."""
        begin, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.int32)])
        self.pool[begin : self.used] = ids
        return begin, len(ids)

    def _encoded(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def _gap(self, gap: bytes, last: bool) -> tuple[int, int]:
        """Tokens of white space before a word, or at the end of a text."""
        key = gap + b"$" if last else gap
        if key not in self.gaps:
            s = gap.decode()
            if last:
                ids = self._encoded(s)
            else:  # the last character stands alone, or goes to the word if it is a space
                ids = (self._encoded(s[:-1]) if len(s) > 1 else []) + ([] if s[-1] == " " else self._encoded(s[-1]))
            self.gaps[key] = self._put(ids)
        return self.gaps[key]

    def of(self, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end, tokens, where each row's begin) of slices of rows."""
        for lo, hi in slices(text, 1 << 19):
            yield (lo, hi, *self._of(text.slice(lo, hi - lo)))
            if self.used > self.POOL:
                self._empty()

    def _of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = words(text, _NOT_SPACE)
        doc = w.doc()
        n = len(doc)
        start = length = np.zeros(0, np.int64)
        odd = previous = np.zeros(0, np.int64)
        if n:
            begin = w.byte_first[doc]
            space = (w.start > begin) & (w.raw[np.maximum(w.start - 1, 0)] == 32)
            h = (w.hash ^ (space.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
            slot = (h >> np.uint64(45)).astype(np.int64)
            missing = np.flatnonzero(self.keys[slot] != h)
            start, length = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
            if len(missing):
                _, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
                one = missing[at]
                raw = w.raw.tobytes()
                s, e = (w.start - space)[one].tolist(), w.end[one].tolist()
                got = np.array([self._put(self._encoded(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(s, e, strict=True)], np.int64)
                # two words of one slot: whichever was written last stays
                self.keys[slot[one]], self.start[slot[one]], self.count[slot[one]] = h[one], got[:, 0], got[:, 1]
                start[missing], length[missing] = got[back, 0], got[back, 1]
            # white space other than one plain space before a word
            previous = np.concatenate([[0], w.end[:-1]])
            previous = np.where(np.arange(n) == w.first[doc], begin, previous)
            odd = np.flatnonzero((w.start > previous) & ~((w.start - previous == 1) & space))
        c = w.counts()
        tail = np.where(c > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if n else 0, w.byte_first[:-1])
        late = np.flatnonzero(w.byte_first[1:] > tail)
        wide = np.unique(np.searchsorted(w.byte_first, _wide_spaces(w.raw), "right") - 1)
        gaps = [self._gap(w.raw[previous[k] : w.start[k]].tobytes(), False) for k in odd.tolist()]
        gaps += [self._gap(w.raw[tail[k] : w.byte_first[k + 1]].tobytes(), True) for k in late.tolist()]
        gaps += [self._put(self._encoded(text[k].as_py())) for k in wide.tolist()]
        more = np.array(gaps, np.int64).reshape(-1, 2)
        # in order: of a text each word after the white space before it, then the white space at its end
        own = np.concatenate([doc, doc[odd] if n else odd, late, wide])
        place = np.concatenate([2 * np.arange(n) + 1, 2 * odd, np.full(len(late) + len(wide), 2 * n + 1)])
        start, length = np.concatenate([start, more[:, 0]]), np.concatenate([length, more[:, 1]])
        if len(wide):  # these are encoded whole
            keep = ~np.isin(own, wide)
            keep[len(own) - len(wide) :] = True
            own, place, start, length = own[keep], place[keep], start[keep], length[keep]
        order = np.lexsort((place, own))
        own, start, length = own[order], start[order], length[order]
        ends = np.cumsum(length)
        flat = self.pool[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        size = np.bincount(own, weights=length, minlength=len(text)).astype(np.int64)
        return flat, np.concatenate([[0], np.cumsum(size)])


def _wide_spaces(raw: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins: U+85, A0, 1680, 2000 to 200A, 2028, 2029, 202F, 205F and 3000 in UTF-8."""
    two = np.flatnonzero(raw[:-1] == 0xC2)
    two = two[np.isin(raw[two + 1], (0x85, 0xA0))]
    three = np.flatnonzero((raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3))
    code = (raw[three].astype(np.int32) << 16) | (raw[three + 1].astype(np.int32) << 8) | raw[three + 2]
    spaces = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)
    return np.concatenate([two, three[np.isin(code, spaces)]])


@dataclass
class Load:
    """Tokens of a document's part, or of a window that is packed again: where they come from, and they themselves."""

    pieces: list[tuple[int, int, int]]  # document, first token, tokens
    tokens: list[np.ndarray]


class Packer:
    """At most ``open_windows`` windows at once; ``put`` returns the window that had to go, if any."""

    def __init__(self, capacity: int, open_windows: int) -> None:
        self.capacity, self.most = capacity, open_windows
        self.room: list[tuple[int, int]] = []  # (tokens free, number), ascending
        self.loads: dict[int, Load] = {}
        self.began = 0

    def put(self, size: int, load: Load) -> Load | None:
        out = None
        k = bisect_left(self.room, (size, -1))
        if k < len(self.room):
            free, number = self.room.pop(k)
        else:
            if len(self.room) >= self.most:
                out = self.loads.pop(self.room.pop(0)[1])
            free, number = self.capacity, self.began
            self.began += 1
            self.loads[number] = Load([], [])
        self.loads[number].pieces += load.pieces
        self.loads[number].tokens += load.tokens
        if free == size:  # never a new window: what is as large as a window doesn't get here
            return self.loads.pop(number)
        insort(self.room, (free - size, number))
        return out

    def rest(self) -> list[Load]:
        left = [self.loads[n] for _, n in self.room]
        self.room, self.loads = [], {}
        return left


_OUT = "bucket long, place int, open boolean, tokens int, doc_ids array<long>, starts array<long>, lengths array<long>, token_ids array<int>"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


class _Writer:
    """Windows as Arrow batches of about ``most`` tokens."""

    def __init__(self, bucket: int, most: int = 1 << 19) -> None:
        self.bucket, self.most, self.held, self.size, self.place = bucket, most, [], 0, 0

    def add(self, load: Load, open_: bool = False) -> Iterator[pa.RecordBatch]:
        self.held.append((open_, load))
        self.size += sum(map(len, load.tokens))
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        n = len(self.held)
        pieces = [p for _, w in self.held for p in w.pieces]
        by = np.concatenate([[0], np.cumsum([len(w.pieces) for _, w in self.held])]).astype(np.int32)
        sizes = np.array([sum(map(len, w.tokens)) for _, w in self.held], np.int32)
        flat = np.concatenate([t for _, w in self.held for t in w.tokens])
        lists = [pa.ListArray.from_arrays(pa.array(by), pa.array([p[k] for p in pieces], pa.int64())) for k in range(3)]
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        place = pa.array(np.arange(self.place, self.place + n, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.bucket)), place, pa.array([o for o, _ in self.held]), pa.array(sizes), *lists, ids], names=_NAMES)
        self.held, self.size, self.place = [], 0, self.place + n


def _pack_documents(tokenizer: str, capacity: int, open_windows: int):
    """The windows of a partition of (id, text) rows. Longer documents than a window fill windows of their own and leave their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(capacity, open_windows), _Writer(TaskContext.get().partitionId())
        for b in batches:
            ids = b["id"].to_numpy()
            for lo, hi, flat, at in Tokens.at(tokenizer).of(b["text"]):
                for k in range(hi - lo):
                    begin, end, start = int(at[k]), int(at[k + 1]), 0
                    one = int(ids[lo + k])
                    while end - begin - start >= capacity:
                        yield from out.add(Load([(one, start, capacity)], [flat[begin + start : begin + start + capacity]]))
                        start += capacity
                    size = end - begin - start
                    if size and (full := packer.put(size, Load([(one, start, size)], [flat[begin + start : end].copy()]))) is not None:
                        yield from out.add(full)
        for w in packer.rest():
            yield from out.add(w, True)
        yield from out.flush()

    return run


def _pack_again(capacity: int, open_windows: int):
    """The windows of buckets of windows, sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = out = None
        for b in batches:
            lists = [b[c].to_pylist() for c in ("doc_ids", "starts", "lengths")]
            ends = b["token_ids"].offsets.to_numpy()
            flat = b["token_ids"].values.to_numpy()
            for i, bucket in enumerate(b["bucket"].to_pylist()):
                if out is None or bucket != out.bucket:
                    if out is not None:
                        for w in packer.rest():
                            yield from out.add(w, True)
                        yield from out.flush()
                    packer, out = Packer(capacity, open_windows), _Writer(bucket)
                load = Load(list(zip(*(x[i] for x in lists), strict=True)), [flat[ends[i] : ends[i + 1]].copy()])
                if (full := packer.put(int(ends[i + 1] - ends[i]), load)) is not None:
                    yield from out.add(full)
        if out is not None:
            for w in packer.rest():
                yield from out.add(w, True)
            yield from out.flush()

    return run


def pack(docs: DataFrame, *, tokenizer: str = TOKENIZER, capacity: int = 2048, open_windows: int = 32, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tokens, doc_ids, starts, lengths, token_ids) of the windows that hold all tokens of ``docs``.

    ``token_ids`` are those of the window; its pieces, in order, are ``lengths[k]`` tokens from number ``starts[k]`` of the row with the id ``doc_ids[k]``.
    Which documents meet depends on how the table is cut into partitions, nothing else. Null and empty texts have no tokens and are in no window; rows
    without an id are left out. Longer texts than a window fill windows of their own and leave their end to be packed. Repeated rows are packed each; ties
    go to the window that opened first. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    if os.path.exists(tokenizer):
        spark.sparkContext.addFile(tokenizer)
    rows = id_and_text(docs, id_col, text_col).where("text <> ''")
    packed = storage.stash(rows.mapInArrow(lean(_pack_documents(tokenizer, capacity, open_windows)), _OUT))
    done = packed.where("not open")
    most = packed.agg(F.max("bucket").alias("b")).first()["b"]
    buckets = 0 if most is None else most + 1
    while buckets:
        last = buckets <= fan_in
        left = packed.where("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
        buckets = -(-buckets // fan_in)
        order = [F.col("doc_ids")[0], F.col("starts")[0], "tokens"]
        left = left.repartition(buckets, "bucket").sortWithinPartitions("bucket", *order)
        packed = storage.stash(left.mapInArrow(lean(_pack_again(capacity, open_windows)), _OUT))
        done = done.union(packed if last else packed.where("not open"))
        if last:
            break
    return done.select("tokens", "doc_ids", "starts", "lengths", "token_ids")
