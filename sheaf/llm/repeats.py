"""Repeated passages by a hash-compared suffix sort.

A passage is ``least`` (50) consecutive words, words being runs of bytes that aren't white space. Of every
``least``-word window the k-gram of least hash is its anchor (the first of equals), so equal windows have
equal anchors at equal distances: windows are brought together by anchor, and an anchor that occurs once in
the corpus ends the matter for all its windows. Where it occurs again, the stretch of text that its windows
cover is sent to one place, and the suffixes that start at equal distances from the anchor are sorted by
mergesort. Two suffixes are compared by the length of their common extension, found by binary search over prefix
polynomial hashes, so a comparison takes logarithmically many steps. Neighbours that agree on ``least``
words are compared word by word before they count, so hash collisions don't.

An anchor that occurs more than ``CROWD`` times is not sorted in one place: each window of its stretches becomes a row of two independent hashes, 128 bits in all, and
equal ones find their first occurrence by aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import storage
from sheaf.llm.tables import id_and_text, spare_name
from sheaf.llm.textops import NOT_SPACE, Words, lean, mix, powers, raw_bytes, slices, words

LEAST, GRAM = 50, 12
CROWD = 1 << 16
_MUL = np.uint64(0xC2B2AE3D27D4EB4F)


def sliding_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by forward and backward minima within blocks."""
    n = len(v)
    if n < w:
        return v[:0]
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(w: Words, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, first window, last window, words from the first to the anchor): windows by their anchor, as first words counted within the document."""
    n = len(w.hash)
    z = np.zeros(0, np.int64)
    if n < least:
        return z.view(np.uint64), z, z, z, z
    # hash of each run of `gram` words
    up, down = powers(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * up[:n])])
    g = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    place = np.arange(len(g), dtype=np.uint64)
    if len(g) >= 1 << 24:
        raise ValueError("too many words in one slice")
    low = sliding_minimum((g & ~np.uint64(0xFFFFFF)) | place, least - gram + 1)
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    p = np.arange(len(at))
    doc = w.doc()[: len(at)]
    ok = p + least <= w.first[1:][doc]
    p, at, doc = p[ok], at[ok], doc[ok]
    if not len(p):
        return z.view(np.uint64), z, z, z, z
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    end = np.concatenate([new[1:], [len(p)]]) - 1
    base = w.first[:-1][doc[new]]
    return g[at[new]], doc[new], p[new] - base, p[end] - base, at[new] - p[new]


_SPOT = "key long, id long, mark long, first int, last int, back int"


def _anchor_rows(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mark = b["id"].to_numpy(), b["mark"].to_numpy()
            for lo, hi in slices(b["text"]):
                w = words(b["text"].slice(lo, hi - lo), NOT_SPACE)
                for part, skip in _parts(w, least):
                    key, doc, first, last, back = anchors(part, least, gram)
                    if len(key):
                        small = [pa.array(v.astype(np.int32)) for v in (first + skip, last + skip, back)]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array(mark[lo:hi][doc]), *small], names=["key", "id", "mark", "first", "last", "back"])

    return run


def _parts(w: Words, least: int, most: int = 1 << 23) -> Iterator[tuple[Words, int]]:
    """The words at once, or, of one enormous document, overlapping stretches that hold every window once."""
    n = len(w.hash)
    if n <= most:
        yield w, 0
        return
    for lo in range(0, n - least + 1, most):
        hi = min(n, lo + most + least - 1)
        yield Words(w.raw, w.start[lo:hi], w.end[lo:hi], w.hash[lo:hi], np.array([0, hi - lo]), w.byte_first), lo


def _cut_rows(least: int):
    """Text of each wanted stretch of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mark = b["id"].to_numpy(), b["mark"].to_numpy()
            spots = b["spots"]
            ends = spots.offsets.to_numpy() - spots.offsets[0].as_py()
            flat = spots.flatten()
            key, first, last, back = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("key", "first", "last", "back"))
            for lo, hi in slices(b["text"]):
                w = words(b["text"].slice(lo, hi - lo), NOT_SPACE)
                x, y = ends[lo], ends[hi]
                if x == y:
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                s = w.start[w.first[doc] + first[x:y]]
                size = w.end[w.first[doc] + last[x:y] + least - 1] - s
                step = np.flatnonzero(np.diff(np.cumsum(size) >> 22)) + 1  # messages of about 4 MB
                for i, j in zip([0, *step], [*step, len(s)], strict=True):
                    off = np.concatenate([[0], np.cumsum(size[i:j])])
                    data = w.raw[np.repeat(s[i:j] - off[:-1], size[i:j]) + np.arange(off[-1])]
                    piece = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(key[x + i : x + j]), pa.array(ids[lo:hi][doc[i:j]]), pa.array(mark[lo:hi][doc[i:j]]), *(pa.array(v[x + i : x + j]) for v in (first, last, back)), piece], names=["key", "id", "mark", "first", "last", "back", "piece"])

    return run


class Suffixes:
    """Suffixes of stretches of words, compared by prefix polynomial hashes up to a depth."""

    def __init__(self, hashes: np.ndarray, depth: int) -> None:
        n = len(hashes)
        self.hash, self.depth = hashes, depth
        up, self.down = powers(n + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:n])])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, at most ``depth``, by binary search."""
        di, dj = self.down[i], self.down[j]
        si, sj = self.sums[i], self.sums[j]
        equal = lambda k: (self.sums[i + k] - si) * di == (self.sums[j + k] - sj) * dj
        whole = equal(np.full(len(i), self.depth))
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), self.depth - 1)
        for _ in range(int(self.depth).bit_length()):
            mid = (lo + hi + 1) >> 1
            ok = equal(mid)
            lo = np.where(ok, mid, lo)
            hi = np.where(ok, hi, mid - 1)
        return np.where(whole, self.depth, lo)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equals aren't before each other."""
        k = self.common(i, j)
        differ = k < self.depth
        k = np.minimum(k, self.depth - 1)
        return differ & (self.hash[i + k] < self.hash[j + k])


def merge_sorted(suffixes: Suffixes, items: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Order of ``items`` (suffix starts) within each run of equal ``segment``: bottom-up stable mergesort, all pairs of runs of a level at once."""
    n = len(items)
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [n]]))
    base = np.repeat(begin, size)
    length = np.repeat(size, size)
    order = np.arange(n)
    run = 1
    active = np.flatnonzero(length > 1)
    while len(active):
        pos = active - base[active]
        pair = pos // (2 * run) * (2 * run)
        left = pos - pair < run
        a = base[active] + np.where(left, np.minimum(pair + run, length[active]), pair)  # the other run
        b = base[active] + np.where(left, np.minimum(pair + 2 * run, length[active]), pair + run)
        lo, hi = a.copy(), np.maximum(a, b)
        own = items[order[active]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            other = items[order[mid]]
            mine = own[open_]
            l_ = left[open_]
            # items of the left run come first among equals
            right_of = np.where(l_, suffixes.before(other, mine), ~suffixes.before(mine, other))
            lo[open_] = np.where(right_of, mid + 1, lo[open_])
            hi[open_] = np.where(right_of, hi[open_], mid)
        in_own = pos - pair - np.where(left, 0, run)
        target = base[active] + pair + in_own + (lo - a)
        new = order.copy()
        new[target] = order[active]
        order = new
        run *= 2
        active = active[length[active] > run]
    return order


_RANGE = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())])


def _ranges(t: pa.Table, least: int) -> pa.RecordBatch:
    """(id, mark, first, last, again): runs of windows that occur again; ``again`` is false where a run is the first occurrence."""
    key, ids, mark, first, last, back = (t[c].to_numpy() for c in ("key", "id", "mark", "first", "last", "back"))
    order = np.lexsort((first, mark, ids, key))
    same = np.zeros(len(order), bool)  # rows that repeat a document bring its stretches twice
    x, y = order[1:], order[:-1]
    same[1:] = (key[x] == key[y]) & (ids[x] == ids[y]) & (mark[x] == mark[y]) & (first[x] == first[y])
    order = order[~same]
    t = t.take(pa.array(order))
    key, ids, mark, first, last, back = (t[c].to_numpy() for c in ("key", "id", "mark", "first", "last", "back"))
    w = words(t["piece"].combine_chunks(), NOT_SPACE)
    count = (last - first + 1).astype(np.int64)
    row = np.repeat(np.arange(len(key)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    item = w.first[:-1][row] + offset
    # equal windows have the same anchor at the same distance: only such suffixes are sorted together
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    sub = (group[row] << 32) | (back[row] - offset + (1 << 24))
    arrange = np.argsort(sub, kind="stable")  # and by (id, place) within
    item, sub, row, offset = item[arrange], sub[arrange], row[arrange], offset[arrange]
    s = Suffixes(w.hash, least)
    sort = merge_sorted(s, item, sub)
    item, row, offset = item[sort], row[sort], offset[sort]
    near = np.flatnonzero(sub[1:] == sub[:-1])
    equal = near[s.common(item[near], item[near + 1]) >= least]
    equal = equal[_same_words(w, item[equal], item[equal + 1], least)]
    again = np.zeros(len(item), bool)  # the mergesort is stable: the first of equals is the first occurrence
    again[equal + 1] = True
    repeated = again.copy()
    repeated[equal] = True
    out = np.flatnonzero(repeated)
    place = np.lexsort((offset[out], row[out]))
    r, o, g = row[out][place], offset[out][place], again[out][place]
    if not len(r):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _RANGE], schema=_RANGE)
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1) | (g[1:] != g[:-1])]))
    end = np.concatenate([new[1:], [len(r)]]) - 1
    return pa.RecordBatch.from_arrays([pa.array(ids[r[new]]), pa.array(mark[r[new]]), pa.array((first[r[new]] + o[new]).astype(np.int32)), pa.array((first[r[new]] + o[end]).astype(np.int32)), pa.array(g[new])], schema=_RANGE)


def _same_words(w: Words, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    """Collision check: the bytes of all words of both windows. Words of a window that continues the pair before it are compared once."""
    if not len(i):
        return np.zeros(0, bool)
    order = np.lexsort((i, j - i))
    x, y = i[order], j[order]
    follows = np.zeros(len(x), bool)
    follows[1:] = (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1)
    need = np.where(follows, 1, least)
    left = np.repeat(x + least - need, need) + (np.arange(need.sum()) - np.repeat(np.cumsum(need) - need, need))
    right = left + np.repeat(y - x, need)
    ok = _same_bytes(w, left, right)
    wrong = np.repeat(np.arange(len(x)), need)[~ok]
    good = np.ones(len(x), bool)
    for k in wrong:  # collisions only
        good[k] = False
        nxt = k + 1
        while nxt < len(x) and follows[nxt] and nxt - k < least:
            good[nxt] = False
            nxt += 1
    out = np.empty(len(x), bool)
    out[order] = good
    return out


def _same_bytes(w: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    size = w.end[i] - w.start[i]
    ok = size == w.end[j] - w.start[j]
    for k in range(0, int(size.max(initial=0))):
        live = np.flatnonzero(ok & (size > k)) if k > 12 or k == 0 else live[size[live] > k]
        if not len(live):
            break
        same = w.raw[w.start[i[live]] + k] == w.raw[w.start[j[live]] + k]
        ok[live[~same]] = False
        live = live[same]
    return ok


def _sorter(least: int, most: int = 1 << 20):
    """Sorts the stretches of whole anchors, about ``most`` bytes of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key = b["key"].to_numpy()
            total = np.concatenate([[0], np.cumsum(np.diff(raw_bytes(b["piece"])[1]))])
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if last is not None and key[0] != last:
                cuts = np.concatenate([[0], cuts])
            begin = 0
            for c in cuts:
                if size + total[c] - total[begin] >= most:
                    if c > begin:
                        parts.append(b.slice(begin, c - begin))
                    yield _ranges(pa.Table.from_batches(parts), least)
                    parts, size, begin = [], 0, int(c)
            parts.append(b.slice(begin))
            size += int(total[-1] - total[begin])
            last = key[-1]
        if parts:
            yield _ranges(pa.Table.from_batches(parts), least)

    return run


def _window_rows(least: int):
    """(h1, h2, id, mark, at) of each window of the wanted stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mark = b["id"].to_numpy(), b["mark"].to_numpy()
            spots = b["spots"]
            ends = spots.offsets.to_numpy() - spots.offsets[0].as_py()
            flat = spots.flatten()
            first, last = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
            for lo, hi in slices(b["text"]):
                w = words(b["text"].slice(lo, hi - lo), NOT_SPACE)
                x, y = ends[lo], ends[hi]
                if x == y:
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                many = (last - first + 1)[x:y].astype(np.int64)
                doc = np.repeat(doc, many)
                at = np.repeat(first[x:y].astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                place = w.first[doc] + at
                up, down = powers(len(w.hash) + 1)
                both = []
                for h in (w.hash, mix(w.hash ^ _MUL)):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
                    both.append(mix((sums[place + least] - sums[place]) * down[place]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(ids[lo:hi][doc]), pa.array(mark[lo:hi][doc]), pa.array(at.astype(np.int32))], names=["h1", "h2", "id", "mark", "at"])

    return run


def _crowded_ranges(rows: DataFrame, least: int, keep: list[str]) -> DataFrame:
    """As ``_ranges``, of (id, mark, text, spots) with crowded anchors only."""
    w = storage.stash(rows.mapInArrow(lean(_window_rows(least)), "h1 long, h2 long, id long, mark long, at int"), keep)
    spot = F.struct("id", "mark", "at")
    ends = w.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").drop("last")
    return w.join(ends.withColumnRenamed("first", "f"), ["h1", "h2"]).select("id", "mark", F.col("at").alias("first"), F.col("at").alias("last"), (spot != F.col("f")).alias("again")).distinct()


def repeated_ranges(docs: DataFrame, least: int, gram: int, keep: list[str], crowd: int = CROWD) -> DataFrame:
    """Runs of windows that occur again, of (id, text) rows with ``mark``, a hash of the text."""
    spots = storage.stash(docs.mapInArrow(lean(_anchor_rows(least, gram)), _SPOT), keep)
    often = storage.stash(spots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), keep)
    many = often.where(F.col("n") > crowd).select("key")
    counts = often.count()
    # a key that occurs twice takes two rows of spots at least, so this is small only if the corpus repeats little
    wanted = spots.join(storage.hinted(often, counts, 24), "key").select(*spots.columns, (F.col("n") > crowd).alias("full"))
    spot = F.struct("key", "first", "last", "back")
    lists = [F.collect_set(F.when(F.col("full") == full, spot)).alias(name) for name, full in (("spots", False), ("crowded", True))]
    per_doc = storage.stash(wanted.groupBy("id", "mark").agg(*lists), keep)
    size = per_doc.agg(F.sum((F.size("spots") + F.size("crowded")) * 24 + 32 + storage.ROW_BYTES).alias("b")).first()["b"] or 0
    rows = docs.join(storage.hinted(per_doc, 1, size), ["id", "mark"]).select("id", "mark", "text", "spots", "crowded")
    crowds = many.limit(1).count() > 0
    if crowds:  # both ways read the texts that are joined once: only they are written, while a second join would shuffle all texts
        rows = storage.stash(rows, keep)
    pieces = rows.where(F.size("spots") > 0).drop("crowded").mapInArrow(lean(_cut_rows(least)), _SPOT + ", piece binary")
    out = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_sorter(least)), "id long, mark long, first int, last int, again boolean")
    return out.union(_crowded_ranges(rows.where(F.size("crowded") > 0).drop("spots").withColumnRenamed("crowded", "spots"), least, keep)) if crowds else out


def _marked_spans(docs: DataFrame, least: int, gram: int, keep: list[str], crowd: int = CROWD) -> DataFrame:
    r = repeated_ranges(docs, least, gram, keep, crowd).withColumn("end", F.col("last") + least)
    by = Window.partitionBy("id", "mark", "again").orderBy("first", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.groupBy("id", "mark", "again", "island").agg(F.min("first").alias("start_word"), F.max("end").alias("end_word")).drop("island")


def spans(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, again) of the passages of ``least`` words or more that occur more than once.

    Words count from 0, ``end_word`` is excluded. Spans with ``again`` true are covered by windows of which
    an equal one came earlier, by id and then by place; those with false by first occurrences. A passage that repeats within one
    document counts too, overlapping itself or not. Null, empty and short texts have no spans, nor have rows without an id. Rows that
    repeat id and text count once; rows of one id with different texts are different documents in all but name. Texts are used whole,
    whatever their length. Other columns are not read; an empty table gives an empty result.
    """
    old: list[str] = []
    d = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    out = storage.stash(_marked_spans(d, least, gram, old, crowd))
    storage.discard(docs.sparkSession, old)
    return out.select(F.col("id").alias(id_col), "start_word", "end_word", "again").distinct()


def _remover(text: str, cut: str, count: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            col, lists = b.column(names.index(text)), b.column(names.index(cut))
            new = []
            for t, spans_ in zip(col, lists, strict=True):
                if not spans_.is_valid or not len(spans_):
                    new.append(t.as_py())
                    continue
                w = words(pa.array([t.as_py()]), NOT_SPACE)
                raw, keep, at = w.raw.tobytes(), [], 0
                for s in sorted((x["start_word"], x["end_word"]) for x in spans_.as_py()):
                    keep.append(raw[at : w.start[s[0]]])
                    at = int(w.end[s[1] - 1])
                keep.append(raw[at:])
                new.append(b"".join(keep).decode("utf-8", "replace").strip())
            out = pa.array(new, b.schema.field(text).type)
            arrays = [out if n == text else c for n, c in zip(names, b.columns, strict=True)]
            if count:
                touched = pa.array([x.is_valid and len(x) > 0 for x in lists])
                k = names.index(count)
                arrays[k] = pc.if_else(touched, pc.cast(pc.utf8_length(out), b.schema.field(count).type), arrays[k])
            done = pa.RecordBatch.from_arrays([a for a, n in zip(arrays, names, strict=True) if n != cut], names=[n for n in names if n != cut])
            gone = pa.array([x.is_valid and len(x) > 0 and not v for x, v in zip(lists, new, strict=True)])
            yield done.filter(pc.invert(gone))

    return run


def without_repeats(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` without the words of repeated passages, but for their first occurrence.

    A text that is cut loses the words of its spans and white space at its ends; ``count_col``, if there, becomes its new
    length in characters. A document of which nothing is left goes. All others stay as they are, and so do rows without an id and null, empty and short texts. Rows that
    repeat id and text are cut alike; an empty table gives an empty result.
    """
    old: list[str] = []
    spark = docs.sparkSession
    d = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    cut = storage.stash(_marked_spans(d, least, gram, old).where("again").groupBy("id", "mark").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")))
    storage.discard(spark, old)
    size = cut.agg(F.sum(F.size("spans") * 16 + 32 + storage.ROW_BYTES).alias("b")).first()["b"] or 0
    names = [spare_name(docs, n) for n in ("cut_id", "cut_mark", "cut_spans")]
    cut = storage.hinted(cut.toDF(*names), 1, size)
    joined = docs.join(cut, (docs[id_col].cast("long") == cut[names[0]]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == cut[names[1]]), "left").drop(names[0], names[1])
    return joined.mapInArrow(lean(_remover(text_col, names[2], count_col if count_col in docs.columns else None)), docs.schema)
