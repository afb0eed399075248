"""Toxicity by a subsequence string kernel and a support vector machine on Nystroem landmarks.

The kernel of two strings sums, over all triples of characters that both hold in order, with gaps or without,
DECAY to the power of the lengths they span in each; it is normalised to 1 for equal strings. So a word stays close
to an insult when characters are inserted, dropped or spelled apart. A sentence is scored by its most toxic word, a text
by its most toxic sentence.

Labels say that a text holds a toxic sentence, not which, and not which word makes it so. So the machine learns from many
instances at a time: every toxic text is stood for by the best word of its best sentence, other sentences by theirs if
these score as toxic, too. The choice begins with the words' odds of being in toxic texts and is made anew by the machine
after each fit; a text in which it finds nothing is taken for wrongly labelled in that round. All words of clean texts are
negatives. The threshold comes from labelled texts that were held out.

Landmarks span the feature space. The decision function is linear in the kernel features, so the trained
machine is folded into one weight for each triple of symbols, which gives the same scores at a fraction of the cost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.tables import id_and_text
from sheaf.llm.textops import NOT_SPACE, Words, lean, slices, words

SYMBOLS, DECAY, LONGEST = 64, 0.7, 24
#: At most so many toxic and clean labelled documents, least hashes of the id first, train the machine; one of so many of them is held out.
TOXIC, CLEAN, HELD = 3000, 4000, 5
LANDMARKS, ROUNDS = 128, 4


@cache
def _symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 48 <= o <= 57:
        return o - 21
    return 37 + (o * 40503 >> 4) % 27 if o > 127 else 0


def symbols(word: str) -> bytes:
    """Letters and digits as small numbers; other ASCII characters are skipped, other letters share 27 symbols."""
    return bytes(filter(None, map(_symbol, word)))


def pieces(word: str) -> list[bytes]:
    """The word's symbols; a long word as overlapping pieces of LONGEST."""
    s = symbols(word)
    if len(s) <= LONGEST:
        return [s]
    return [s[i : i + LONGEST] for i in range(0, len(s) - LONGEST // 2, LONGEST // 2)]


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], np.int64).reshape(-1, 3).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triple, weight, norm) of words of one length; a short word is filled with the symbol 0."""
    if codes.shape[1] < 3:
        codes = np.pad(codes, ((0, 0), (0, 3 - codes.shape[1])))
    i, j, k, weight = _triples(codes.shape[1])
    t = (codes[:, i] * SYMBOLS + codes[:, j]) * SYMBOLS + codes[:, k]
    order = np.argsort(t, axis=1)
    s = np.take_along_axis(t, order, 1)
    w = weight[order]
    # sums over equal triples of a word, then their squares
    flat = np.cumsum(np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1).ravel()) - 1
    sums = np.bincount(flat, weights=w.ravel().astype(np.float64))
    rows = np.zeros(len(sums), np.int64)
    rows[flat] = np.repeat(np.arange(len(s)), s.shape[1])
    norm = np.sqrt(np.bincount(rows, weights=sums * sums, minlength=len(s)))
    return t, np.broadcast_to(weight, t.shape), np.maximum(norm, 1e-12)


def _by_length(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(u) for u in units], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, 400_000 // max(1, n * n * n // 6))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            yield part, np.frombuffer(b"".join([units[p] for p in part]), np.uint8).astype(np.int64).reshape(len(part), n)


def kernel(units: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel of all units with all landmarks. Memory: a row for each triple that a landmark holds, and blocks of units."""
    parts = [(at, *_features(codes)) for at, codes in _by_length(landmarks)]
    held = np.unique(np.concatenate([t.ravel() for _, t, _, _ in parts])) if parts else np.zeros(0, np.int64)
    row = np.full(SYMBOLS**3, len(held), np.int32)  # the last row is of triples that no landmark holds
    row[held] = np.arange(len(held))
    table = np.zeros((len(held) + 1, len(landmarks)), np.float32)
    for at, t, w, norm in parts:
        np.add.at(table, (row[t], at[:, None]), w / norm[:, None])
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for at, codes in _by_length(units):
        t, w, norm = _features(codes)
        step = max(1, 4_000_000 // (t.shape[1] * max(1, len(landmarks))))
        for lo in range(0, len(at), step):
            out[at[lo : lo + step]] = np.matmul(w[0], table[row[t[lo : lo + step]]]) / norm[lo : lo + step, None]
    return out


def direct_kernel(a: bytes, b: bytes) -> float:
    """The kernel of two strings by its recursion over prefixes, for tests."""

    def raw(s: bytes, t: bytes) -> float:
        before = np.ones((len(s) + 1, len(t) + 1))
        for order in range(1, 3):
            now = np.zeros_like(before)
            for x in range(order, len(s) + 1):
                run = 0.0
                for y in range(order, len(t) + 1):
                    run = DECAY * run + (DECAY**2 * before[x - 1, y - 1] if s[x - 1] == t[y - 1] else 0.0)
                    now[x, y] = DECAY * now[x - 1, y] + run
            before = now
        return sum(DECAY**2 * before[x, y] for x in range(len(s)) for y in range(len(t)) if s[x] == t[y])

    a, b = (u + bytes(3 - len(u)) if len(u) < 3 else u for u in (a, b))
    return raw(a, b) / np.sqrt(raw(a, a) * raw(b, b))


@dataclass(frozen=True)
class Machine:
    """Weights of symbol triples, bias and threshold."""

    weight: np.ndarray
    bias: float
    threshold: float

    def score(self, units: list[bytes]) -> np.ndarray:
        out = np.full(len(units), -1.0)
        for at, codes in _by_length(units):
            t, w, norm = _features(codes)
            out[at] = (self.weight[t] * w).sum(1) / norm + self.bias
        return out

    def score_words(self, strings: list[str]) -> np.ndarray:
        parts = [pieces(s) for s in strings]
        flat = self.score([p for ps in parts for p in ps])
        return np.maximum.reduceat(flat, np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)) if parts else flat


def svm(parts: list[tuple[np.ndarray, float, np.ndarray]], ridge: float = 1.0) -> np.ndarray:
    """Linear machine (weights, bias) with the squared hinge loss of (features, label, costs) parts, by Newton steps on the active set."""
    width = parts[0][0].shape[1] + 1
    theta = np.zeros(width)
    eye = ridge * np.eye(width)
    eye[-1, -1] = 1e-6
    for _ in range(30):
        left, right = eye.copy(), np.zeros(width)
        for x, y, cost in parts:
            on = np.flatnonzero(y * (x @ theta[:-1].astype(x.dtype) + theta[-1]) < 1)
            for lo in range(0, len(on), 1 << 14):
                k = on[lo : lo + (1 << 14)]
                xa = np.hstack([x[k], np.ones((len(k), 1), x.dtype)]).astype(np.float64)
                weighted = xa * cost[k, None]
                left += weighted.T @ xa
                right += y * weighted.sum(0)
        new = np.linalg.solve(left, right)
        moved = np.abs(new - theta).max()
        theta = new
        if moved < 1e-5 * max(1.0, np.abs(theta).max()):
            break
    return theta


@dataclass
class Bags:
    """Sentences as sets of units. ``unit[first[i]:first[i + 1]]`` are those of sentence i, of the text ``text[i]``."""

    units: list[bytes]
    unit: np.ndarray
    first: np.ndarray
    text: np.ndarray
    toxic: np.ndarray  # of each text
    held: np.ndarray  # of each text

    @classmethod
    def of(cls, text: np.ndarray, toxic: np.ndarray, held: np.ndarray, words_of: pa.ListArray) -> Bags:
        """From the text, its label, whether it is held out, and the words of each sentence. Units are numbered in the order of words, so rows may come in any."""
        coded = words_of.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        by = sorted(range(len(names)), key=names.__getitem__)
        numbers: dict[bytes, int] = {}
        own = [[numbers.setdefault(u, len(numbers)) for u in pieces(names[k]) if u] for k in by]
        many = np.zeros(len(names), np.int64)
        many[by] = [len(x) for x in own]
        start = np.zeros(len(names), np.int64)
        start[by] = np.cumsum(many[by]) - many[by]
        flat = np.array([n for x in own for n in x], np.int64)
        word = coded.indices.to_numpy()
        of_word = np.repeat(np.arange(len(text)), np.diff(words_of.offsets.to_numpy()))
        n = many[word]
        unit = flat[np.repeat(start[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        bag = np.repeat(of_word, n)
        key = np.unique(bag * max(1, len(numbers)) + unit)
        _, number = np.unique(text, return_inverse=True)
        size = int(number.max(initial=-1)) + 1
        marks = np.zeros((2, size), bool)
        marks[0][number], marks[1][number] = toxic, held
        first = np.searchsorted(key, np.arange(len(text) + 1) * max(1, len(numbers)))
        return cls([*numbers], key % max(1, len(numbers)), first, number, marks[0], marks[1])

    def texts_with(self, wanted: np.ndarray) -> np.ndarray:
        """How many of the wanted texts hold each unit."""
        doc = self.text[np.repeat(np.arange(len(self.text)), np.diff(self.first))]
        key = np.unique(doc[wanted[doc]] * len(self.units) + self.unit[wanted[doc]])
        return np.bincount(key % max(1, len(self.units)), minlength=len(self.units))

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of greatest score of each sentence that has any, and those sentences. Ties: the unit seen first."""
        has = np.flatnonzero(np.diff(self.first))
        owner = np.repeat(np.arange(len(self.text)), np.diff(self.first))
        order = np.lexsort((self.unit, -score[self.unit], owner))
        return self.unit[order[np.searchsorted(owner[order], has)]], has

    def of_texts(self, score: np.ndarray) -> np.ndarray:
        """The greatest score of each text."""
        out = np.full(len(self.toxic), -np.inf)
        unit, has = self.best(score)
        np.maximum.at(out, self.text[has], score[unit])
        return out


def _witnesses(bags: Bags, score: np.ndarray, least: float, others: float) -> np.ndarray:
    """For each unit, how many toxic training texts it stands for: as best of the text, or of another sentence with a score over ``others``. Texts under ``least`` have none."""
    unit, has = bags.best(score)
    top = bags.of_texts(score)
    text = bags.text[has]
    fine = bags.toxic[text] & ~bags.held[text] & (top[text] >= least) & ((score[unit] >= top[text]) | (score[unit] > others))
    key = np.unique(text[fine] * len(bags.units) + unit[fine])
    return np.bincount(key % max(1, len(bags.units)), minlength=len(bags.units))


def _varied(units: list[bytes], weight: np.ndarray, share: float) -> dict[bytes, float]:
    """The units, and those of a ``share`` of the greatest weight or more with one character inserted, so that the margin leaves room for it."""
    out = dict(zip(units, map(float, weight), strict=True))
    for u, w in zip(units, weight, strict=True):
        if w >= share * weight.max():
            for i in range(1, len(u)):
                for c in (u[i - 1], 24, 17):
                    out.setdefault(u[:i] + bytes([c]) + u[i:], float(w) / len(u))
    return out


def _farthest(pool: list[bytes], gain: np.ndarray, most: int) -> list[int]:
    """Members with much gain and far from each other, by one kernel column for each that is chosen."""
    parts = [(at, t.astype(np.int32), w[0], norm) for at, codes in _by_length(pool) for t, w, norm in [_features(codes)]]
    chosen: list[int] = []
    closest = np.zeros(len(pool), np.float32)
    while len(chosen) < min(most, len(pool)):
        k = int(np.argmax(gain * (1 - closest)))
        if gain[k] <= 0 or closest[k] > 0.995:
            break
        chosen.append(k)
        own = _folded([pool[k]], np.ones(1), 0.0).weight
        for at, t, w, norm in parts:
            closest[at] = np.maximum(closest[at], own[t] @ w / norm)
    return chosen


def _mapped(units: list[bytes], marks: list[bytes], whiten: np.ndarray) -> np.ndarray:
    """Nystroem features."""
    out = np.zeros((len(units), whiten.shape[1]), np.float32)
    for lo in range(0, len(units), 1 << 15):
        out[lo : lo + (1 << 15)] = kernel(units[lo : lo + (1 << 15)], marks) @ whiten
    return out


def threshold_of(toxic: np.ndarray, clean: np.ndarray, alarm: float = 10.0) -> float:
    """A score of least loss, missed shares of toxic texts counting 1 and flagged ones of clean texts ``alarm``: the one next to 0, a quarter of the way from its neighbours at least; 0 without both."""
    if not len(toxic) or not len(clean):
        return 0.0
    at = np.unique(np.concatenate([toxic, clean, [-1.0, 1.0]]))
    low, high = at[:-1], at[1:]
    cut = np.clip(0.0, low + (high - low) / 4, high - (high - low) / 4)
    loss = np.searchsorted(np.sort(toxic), cut) / len(toxic) + alarm * (1 - np.searchsorted(np.sort(clean), cut) / len(clean))
    return float(min(cut[loss <= loss.min() + 1e-9], key=abs))


def learn(bags: Bags, landmarks: int = LANDMARKS, rounds: int = ROUNDS, near: float = 0.4, share: float = 0.05) -> Machine:
    """The machine from labelled sentences. Without toxic or clean ones it finds nothing."""
    nothing = Machine(np.zeros(SYMBOLS**3, np.float32), -1.0, 0.0)
    a, b = bags.texts_with(bags.toxic & ~bags.held), bags.texts_with(~bags.toxic & ~bags.held)
    negative = np.flatnonzero(b)
    if not a.any() or not len(negative):
        return nothing
    score = np.log((a + 0.5) / (b + 0.5))
    clean_units = [bags.units[k] for k in negative]
    cost = np.sqrt(b[negative].astype(np.float64))
    cost *= 1000 / cost.sum()
    toxic_units = np.unique(bags.unit[np.repeat(bags.toxic[bags.text], np.diff(bags.first))])
    marks: list[bytes] = []
    machine = nothing
    for r in range(rounds):
        support = _witnesses(bags, score, -np.inf if r == 0 else -0.5, np.inf if r == 0 else 0.0)
        chosen = np.flatnonzero(support)
        if not len(chosen):
            break
        varied = _varied([bags.units[k] for k in chosen], support[chosen], share)
        pos, weight = [*varied], np.array([*varied.values()])
        if r < 2:  # landmarks: half of them positives, the others clean words near to these
            pool = [bags.units[k] for k in chosen]
            marks = [pool[k] for k in _farthest(pool, np.log1p(support[chosen]), landmarks // 2)]
            close = kernel(clean_units, marks).max(1)
            there = np.flatnonzero(close >= near)
            marks += [clean_units[there[k]] for k in _farthest([clean_units[k] for k in there], close[there], landmarks - len(marks))]
            values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
            ok = values > 1e-4
            whiten = (vectors[:, ok] / np.sqrt(values[ok])).astype(np.float32)
            xn = _mapped(clean_units, marks, whiten)
        xp = _mapped(pos, marks, whiten)
        for _ in range(3):
            theta = svm([(xp, 1.0, 2000 * weight / weight.sum()), (xn, -1.0, cost)])
            wrong = xn @ theta[:-1].astype(np.float32) + theta[-1] > -0.5
            # a clean word that is mistaken costs all texts that hold it
            cost[wrong] = np.minimum(cost[wrong] * 4, 20.0)
        machine = _folded(marks, whiten @ theta[:-1], float(theta[-1]))
        score = np.full(len(bags.units), -np.inf)
        score[toxic_units] = machine.score([bags.units[k] for k in toxic_units])
    out = np.unique(bags.unit[np.repeat(bags.held[bags.text], np.diff(bags.first))])
    score[out] = machine.score([bags.units[k] for k in out])
    top = bags.of_texts(score)
    has = bags.held & np.isfinite(top)
    return Machine(machine.weight, machine.bias, threshold_of(top[has & bags.toxic], top[has & ~bags.toxic]))


def _folded(units: list[bytes], alpha: np.ndarray, bias: float) -> Machine:
    """One weight for each triple from the weights of units."""
    table = np.zeros(SYMBOLS**3)
    for at, codes in _by_length(units):
        t, w, norm = _features(codes)
        for r, m in enumerate(at):
            np.add.at(table, t[r], alpha[m] * w[r] / norm[r])
    return Machine(table.astype(np.float32), bias, 0.0)


_RUN = re.compile(r"(?:^|(?<=\s))\S(?:[ \t]\S){2,}(?=\s|$)")


def _spelled(text: str) -> list[str]:
    """Words spelled as single characters between blanks."""
    return ["".join(m.group().split()) for m in _RUN.finditer(text)]


class WordScores:
    """Scores of the words of texts, kept in a table by hash."""

    SLOTS = 1 << 20

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.values = np.zeros(self.SLOTS)

    def texts(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), np.nan)
        for lo, hi in slices(column):
            text = pc.utf8_lower(column.slice(lo, hi - lo))
            w = words(text, NOT_SPACE)
            has = np.flatnonzero(w.counts())
            if not len(has):
                continue
            s = self._words(w)
            best = np.maximum.reduceat(s, w.first[:-1][has])
            for k in self._runs(w):
                doc = int(np.searchsorted(has, k))
                extra = self.machine.score_words(_spelled(text[k].as_py()) or ["."])
                best[doc] = max(best[doc], float(extra.max()))
            out[lo + has] = best
        return out

    @staticmethod
    def _runs(w: Words) -> np.ndarray:
        """Documents with three single characters in a row."""
        one = (w.end - w.start == 1) | ((w.end - w.start == 2) & (w.raw[w.start] > 127))
        three = np.flatnonzero(one[2:] & one[1:-1] & one[:-2])
        doc = w.doc()
        return np.unique(doc[three][doc[three] == doc[three + 2]])

    def _words(self, w: Words) -> np.ndarray:
        h = w.hash | np.uint64(1)
        slot = (h >> np.uint64(44)).astype(np.int64)
        s = self.values[slot]
        missing = np.flatnonzero(self.keys[slot] != h)
        if len(missing):
            _, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            one = missing[at]
            raw = w.raw.tobytes()
            strings = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)]
            new = self.machine.score_words(strings)
            self.keys[slot[one]], self.values[slot[one]] = h[one], new
            s[missing] = new[back]
        return s


_END = re.compile(r"[.!?\n]+")
_BAG = "id long, t int, words array<string>"


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lower-case words of each sentence of a toxic text, and of a clean text as a whole."""
    for b in batches:
        for one, t, text in zip(b["id"].to_pylist(), b["t"].to_pylist(), b["text"], strict=True):
            s = text.as_py().lower()
            bags = [sorted({*x.split(), *_spelled(x)}) for x in (_END.split(s) if t else [s])]
            bags = [x for x in bags if x]
            if bags:
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(bags), pa.int64()), pa.array([t] * len(bags), pa.int32()), pa.array(bags, pa.list_(pa.string()))], names=["id", "t", "words"])


def train(docs: DataFrame, labels: DataFrame, *, toxic: int = TOXIC, clean: int = CLEAN, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine from the sentences of documents that ``labels.toxic`` marks, at most ``toxic`` and ``clean`` of them.

    One in ``held`` of these is kept back for the threshold. Labels without an id or a mark don't count; an id that is labelled
    both ways is toxic. Null, empty and blank texts have no sentences; words of any length are learned whole, in overlapping pieces. Rows that repeat an
    id add their sentences to one text. An empty table on either side, or labels of one sort only, give a machine that flags nothing. Other columns are not read.
    """
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels["toxic"].cast("int").alias("t")).where("id is not null and t is not null").groupBy("id").agg(F.max("t").alias("t"))
    one = lambda v, n: marks.where(F.col("t") == v).orderBy(F.xxhash64("id"), "id").limit(n)
    take = one(1, toxic).union(one(0, clean))
    # the sample is bounded by the two parameters, and so is what is broadcast
    d = id_and_text(docs, id_col, text_col).join(F.broadcast(take), "id").select("id", "t", "text")
    got = d.mapInArrow(lean(_sentence_rows), _BAG).select("id", "t", "words", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(held)).alias("part")).toArrow()
    if not got.num_rows:
        return learn(Bags.of(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool), pa.array([], pa.list_(pa.string()))))
    got = got.combine_chunks()
    return learn(Bags.of(got["id"].to_numpy(), got["t"].to_numpy() == 1, got["part"].to_numpy() == 0, got["words"].combine_chunks()))


_scorers: dict[int, WordScores] = {}


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, toxic) of every row with an id: the score of the most toxic word of any sentence.

    A text without words (null, empty, white space) has a null score and isn't toxic. Texts and words of any length are scored whole; rows that
    repeat an id are scored each. Other columns are not read; an empty table gives an empty result.
    """
    token = hash((machine.weight.tobytes(), machine.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _scorers:
            _scorers.clear()
            _scorers[token] = WordScores(machine)
        for b in batches:
            s = _scorers[token].texts(b["text"])
            has = ~np.isnan(s)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.round(s, 6), mask=~has), pa.array(has & (np.nan_to_num(s, nan=-9.0) > machine.threshold))], names=["id", "score", "toxic"])

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run), "id long, score double, toxic boolean").withColumnRenamed("id", id_col)
