"""Quality classifier learned from trusted positives and unlabelled text.

The risk minimised is the non-negative unbiased one for positive-unlabelled data: with class prior pi,
risk = pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)). When the second part
becomes negative only its own gradient is followed, upwards. The prior is estimated from a first fit by the best
bin: the least upper bound, over score thresholds, of the ratio of unlabelled to positive rates above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.tables import id_and_text, spare_name
from sheaf.llm.textops import NOT_SPACE, lean, mix, slices, words

#: At most so many trusted positives and so many unlabelled documents, least hashes of the id first, train the model.
POSITIVES, UNLABELLED = 6000, 12000


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[[ord(c) for c in chars]] = 1
    return t


_LOWER, _UPPER, _DIGIT = _class("abcdefghijklmnopqrstuvwxyz"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_STOP, _LOUD, _SYMBOL = _class(".,;:'\"-()"), _class("!?"), _class("#$%&*+/<=>@[\\]^_`{|}~")
_WIDE = np.zeros(256, np.float32)
_WIDE[128:] = 1
_ENDS = (_SYMBOL + _LOUD) > 0
NAMES = ("upper", "digit", "loud", "symbol", "stop", "wide", "space", "word_length", "symbol_ends", "repeated_neighbour", "repeated_4grams", "repeated_lines", "one_sort", "long_words")


def features(text: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; zeros for one without words."""
    out = np.zeros((len(text), len(NAMES)))
    for lo, hi in slices(text):
        out[lo:hi] = _features(text.slice(lo, hi - lo))
    return out


def _features(text: pa.Array) -> np.ndarray:
    w = words(text, NOT_SPACE)
    x = np.zeros((len(text), len(NAMES)))
    has = np.flatnonzero(w.counts())
    if not len(has):
        return x
    at = w.byte_first[:-1][has]
    n = np.diff(w.byte_first)[has].astype(float)
    share = lambda t: np.add.reduceat(t[w.raw], at)
    upper, lower, wide = share(_UPPER), share(_LOWER), share(_WIDE)
    c = w.counts()[has].astype(float)
    first = w.first[:-1][has]
    # shares of a few words say little: below 6 words or 24 letters they count as if among so many
    per_word = lambda v: np.add.reduceat(v.astype(np.float64), first) / np.maximum(c, 6)
    doc = w.doc()
    length = w.end - w.start
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    quad = w.hash.copy()
    for k in range(1, 4):
        quad[:-k] = quad[:-k] * np.uint64(31) + w.hash[k:]
    inside = np.arange(len(doc)) + 4 <= w.first[1:][doc]
    again = _repeats(quad, doc) & inside
    # lines: hashes of the words between line ends
    ends = np.searchsorted(np.flatnonzero(w.raw == 10), w.start)
    line = np.cumsum(np.concatenate([[True], (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])])) - 1
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    place = mix((np.arange(len(doc)) - begin[line]).astype(np.uint64)) | np.uint64(1)
    line_again = _repeats(np.add.reduceat(w.hash * place, begin), doc[begin])
    x[has] = np.stack(
        [
            upper / np.maximum(upper + lower + wide, 24),
            share(_DIGIT) / np.maximum(n, 24),
            share(_LOUD) / np.maximum(n, 24),
            share(_SYMBOL) / np.maximum(n, 24),
            share(_STOP) / np.maximum(n, 24),
            wide / n,
            1 - np.minimum(1, np.add.reduceat(length, first) / n),
            np.minimum(np.add.reduceat(length, first) / c, 30) / 30,
            per_word(_ENDS[w.raw[w.end - 1]]),
            per_word(same),
            np.add.reduceat(again.astype(float), first) / np.maximum(c - 3, 6),
            per_word(line_again[line]),
            np.maximum(np.maximum(upper, lower + wide), share(_DIGIT)) / n,
            per_word(length > 25),
        ],
        axis=1,
    )
    return x


def _repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the same value came before in the same document."""
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(h), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of a linear scorer under the non-negative risk with the sigmoid loss, by full-batch Adam."""
    theta = np.zeros(p.shape[1] + 1)
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = one(p), one(u)
    m = v = np.zeros_like(theta)
    for t in range(1, rounds + 1):
        sp, su = _sigmoid(p @ theta), _sigmoid(u @ theta)
        # losses: positive 1 - s, negative s
        gp, gu = ((sp * (1 - sp)) @ p) / len(p), ((su * (1 - su)) @ u) / len(u)
        negative = su.mean() - prior * sp.mean()
        g = -prior * gp + (gu - prior * gp) if negative >= 0 else -(gu - prior * gp)
        g = g + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def class_prior(sp: np.ndarray, su: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, by the best bin of held-out scores."""
    best, ratio = np.inf, 1.0
    slack = np.sqrt(np.log(4 / delta) / 2)
    for q in np.quantile(sp, np.linspace(0, 0.95, 96)):
        a, b = (su >= q).mean(), (sp >= q).mean()
        bound = (a + slack / np.sqrt(len(su)) + slack / np.sqrt(len(sp))) / max(b, 1e-9)
        if bound < best:
            best, ratio = bound, a / max(b, 1e-9)
    return float(np.clip(ratio, 0.02, 0.98))


def fit_arrays(p: np.ndarray, u: np.ndarray, keep_positives: float) -> Model:
    """The model of the positives ``p`` and the unlabelled ``u``; the threshold keeps that share of held-out positives."""
    if not len(p) or not len(u):
        width = len(NAMES)
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, -np.inf)
    both = np.vstack([p, u])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    zp, zu = z(p), z(u)
    # two halves, each judged by the machine of the other; the model is the mean of the two, so every row trains it
    halves = [(zp[k::2], zu[k::2]) for k in (0, 1)] if len(zp) > 3 and len(zu) > 3 else [(zp, zu)] * 2
    prior = 0.5
    for last in (False, False, True):
        fits = [nn_pu(a, b, prior) for a, b in halves]
        other = [(a @ w + c, b @ w + c) for (a, b), (w, c) in zip(halves, fits[::-1], strict=True)]
        held, rest = (np.concatenate([x[k] for x in other]) for k in (0, 1))
        if not last:
            prior = class_prior(held, rest)
    w, b = np.mean([f[0] for f in fits], axis=0), float(np.mean([f[1] for f in fits]))
    return Model(mean, scale, w, b, prior, float(min(0.0, np.quantile(held, 1 - keep_positives))))


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    return ids.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED, keep_positives: float = 0.998, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on documents with ``labels.quality`` = 1 (trusted) and on documents without that mark (unlabelled).

    The sample is bounded by ``positives`` and ``unlabelled``; labels of other documents, null labels and
    contradicting labels of one id are not trusted. Without a positive or an unlabelled document the model keeps all texts that have words.
    """
    d = id_and_text(docs, id_col, text_col)
    trusted = labels.select(labels[id_col].cast("long").alias("id"), labels["quality"].alias("q")).where("id is not null").groupBy("id").agg(F.min("q").alias("q")).where("q = 1").select("id")
    take_p = _sampled(trusted, positives)
    take_u = _sampled(d.join(trusted, "id", "left_anti"), unlabelled)
    take = take_p.withColumn("p", F.lit(True)).union(take_u.withColumn("p", F.lit(False)))
    # the sample is bounded by the two parameters, and so is what is broadcast
    rows = d.join(F.broadcast(take), "id").mapInArrow(lean(_feature_rows), "id long, p boolean, x array<double>").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x = lambda want: np.array([r["x"] for r in rows if r["p"] is want and any(r["x"])]).reshape(-1, len(NAMES))
    return fit_arrays(x(True), x(False), keep_positives)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b["text"])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b["id"], b["p"], flat], names=["id", "p", "x"])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, keep) of every row with an id; a text without words (null, empty, white space) has a null score and is not kept.

    Rows that repeat an id are judged each, texts of any length whole; an empty table gives an empty result, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b["text"])
            has = x.any(axis=1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.round(s, 6), mask=~has), pa.array(has & (s >= model.threshold))], names=["id", "score", "keep"])

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run), "id long, score double, keep boolean").withColumnRenamed("id", id_col)


def only_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns as they are; rows without an id and repeated rows are judged like others.

    Null, empty and blank texts go; texts of any length are judged whole. An empty table gives an empty result; columns may have any names.
    """
    text = spare_name(docs, "text_to_judge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            x = features(b.column(at))
            keep = x.any(axis=1) & (model.score(x) >= model.threshold)
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at], names=[f for i, f in enumerate(b.schema.names) if i != at]).filter(pa.array(keep))

    return docs.withColumn(text, F.coalesce(docs[text_col], F.lit(""))).mapInArrow(lean(run), docs.schema)
