"""Classifiers on held-out texts, decontamination and context mixing against brute force."""

import random

import numpy as np
import pyarrow as pa

from sheaf.llm import decontaminate, lm_score, quality, toxicity

from .data import awkward, empty, prose, table

INSULTS = ("zorblaxer", "snerfling", "grumquatz")


def sentences(r, n, toxic):
    out = []
    for _ in range(n):
        w = [f"{r.choice(['ma', 'li', 'to', 'ren', 'sa'])}{r.choice(['ko', 'ti', 'na', 'del'])}{r.choice(['', 'ra', 'sen'])}" for _ in range(12)]
        if toxic:
            w[r.randrange(12)] = r.choice(INSULTS)
        out.append(" ".join(w) + ".")
    return out


def test_toxicity_on_held_out_variants(spark):
    r = random.Random(1)
    train = sentences(r, 120, True) + sentences(r, 240, False)
    docs = table(spark, list(enumerate(train)))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(360)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    gapped = []
    for w in INSULTS:
        for k in range(2, len(w) - 2):
            gapped += [w[:k] + c + w[k:] for c in ("x", "-", w[k])]
        gapped.append(" ".join(w))
    tested = [f"Ren mako {g} tona sara." for g in gapped] + sentences(r, 100, False)
    got = {x["doc_id"]: x["toxic"] for x in toxicity.scored(table(spark, list(enumerate(tested))), m).collect()}
    assert sum(got[i] for i in range(len(gapped))) >= 0.9 * len(gapped)
    assert not any(got[i] for i in range(len(gapped), len(tested)))
    a = toxicity.scored(awkward(spark), m).collect()
    assert len(a) == 11 and all(x["score"] is None and not x["toxic"] for x in a if x["doc_id"] in (1, 2, 3))
    assert toxicity.scored(empty(spark), m).count() == 0
    none = toxicity.train(empty(spark), labels.where("false"))
    assert not any(x["toxic"] for x in toxicity.scored(docs, none).collect())


def test_kernel_against_its_recursion():
    units = [toxicity.symbols(w) for w in ("banana", "bandana", "cab", "ab", "zzzz", "élan")]
    k = toxicity.kernel(units, units)
    want = np.array([[toxicity.direct_kernel(a, b) for b in units] for a in units])
    assert np.allclose(k, want, atol=1e-5)
    # the folded machine gives the sums over kernel values
    weights = np.arange(6) - 2.5
    m = toxicity._folded(units, weights, 0.25)
    tested = [toxicity.symbols(w) for w in ("bandit", "anna", "x", "lean")]
    full = np.array([[toxicity.direct_kernel(a, b) for b in units] for a in tested])
    assert np.allclose(m.score(tested), full @ weights + 0.25, atol=1e-4)


def test_landmarks_give_the_kernel_back():
    r = random.Random(5)
    units = [toxicity.symbols("".join(r.choice("abcde") for _ in range(r.randrange(3, 8)))) for _ in range(40)]
    full = np.array([[toxicity.direct_kernel(a, b) for b in units] for a in units])
    values, vectors = np.linalg.eigh(toxicity.kernel(units, units).astype(np.float64))
    ok = values > 1e-4
    z = toxicity._mapped(units, units, (vectors[:, ok] / np.sqrt(values[ok])).astype(np.float32))
    assert np.abs(z @ z.T - full).max() < 0.02  # with all units as landmarks nothing is lost
    few = toxicity._farthest(units, np.ones(40), 20)
    assert len(set(few)) == 20
    closest = np.zeros(40)
    for k in few:  # each is the farthest from those before it
        assert (1 - closest[k]) >= (1 - closest).max() - 1e-4
        closest = np.maximum(closest, full[k])


def test_margin_machine_against_gradient():
    r = np.random.default_rng(2)
    xp, xn = r.normal(1, 1, (80, 3)), r.normal(-1, 1, (120, 3))
    cp, cn = np.ones(80), np.full(120, 0.5)
    theta = toxicity.svm([(xp, 1.0, cp), (xn, -1.0, cn)])
    x, y, c = np.vstack([xp, xn]), np.repeat([1.0, -1.0], [80, 120]), np.concatenate([cp, cn])
    slack = np.maximum(0, 1 - y * (x @ theta[:3] + theta[3]))
    g = np.concatenate([theta[:3], [1e-6 * theta[3]]]) - np.concatenate([x.T @ (c * y * slack), [(c * y * slack).sum()]])
    assert np.abs(g).max() < 1e-3


def test_witnesses_and_thresholds():
    b = toxicity.Bags.of(np.array([7, 7, 3, 9]), np.array([True, True, False, True]), np.array([False, False, False, True]), pa.array([["bad", "the"], ["also"], ["the", "also"], ["bad"]]))
    assert b.texts_with(b.toxic & ~b.held).sum() == 3 and b.texts_with(~b.toxic).sum() == 2
    bad = b.units.index(toxicity.symbols("bad"))
    score = np.full(3, -1.0)
    score[bad] = 2.0
    assert toxicity._witnesses(b, score, -0.5, 0.0)[bad] == 1  # the held-out text has none
    assert list(b.of_texts(score)) == [-1.0, 2.0, 2.0]
    assert toxicity.threshold_of(np.array([2.0, 3.0]), np.array([-2.0, -1.5])) == 0.0
    assert 1.0 < toxicity.threshold_of(np.array([2.0, 3.0]), np.array([-2.0, 1.0])) < 2.0
    assert toxicity.threshold_of(np.zeros(0), np.ones(1)) == 0.0


def test_whole_long_words_are_learned(spark):
    r = random.Random(3)
    start = "".join(r.choice("abcdef") for _ in range(30))
    train = [f"{t} {start}{'zorblaxersnerf' if k < 60 else 'mimolatinoda'}." for k, t in enumerate(" ".join(sentences(r, 1, False))[:-1] for _ in range(180))]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(180)], "doc_id long, toxic int")
    m = toxicity.train(table(spark, list(enumerate(train))), labels)
    got = {x["doc_id"]: x["toxic"] for x in toxicity.scored(table(spark, [(0, f"ma {start}zorblaxersnerf"), (1, f"ma {start}mimolatinoda")]), m).collect()}
    assert got == {0: True, 1: False}


def good(r):
    return ". ".join("The " + " ".join(r.choice(["river", "house", "quiet", "morning", "walks", "under", "a", "of", "and"]) for _ in range(12)) for _ in range(r.randrange(2, 7))) + "."


def junk(r):
    return " ".join(r.choice(["BUY!!!", "$$$", "@@@", "1234567", "CLICK>>>", "%%%"]) for _ in range(r.randrange(20, 60)))


def test_quality_from_positives_and_unlabelled(spark):
    r = random.Random(6)
    texts = [good(r) for _ in range(120)] + [junk(r) if k % 3 == 0 else good(r) for k in range(180)]
    docs = table(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(None, 1), (9999, 1), (130, None)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    assert 0.4 <= m.prior <= 0.9
    held = [good(r) for _ in range(80)] + [junk(r) for _ in range(80)]
    got = {x["doc_id"]: x["keep"] for x in quality.scored(table(spark, list(enumerate(held))), m).collect()}
    assert sum(got[i] for i in range(80)) >= 76 and sum(got[i] for i in range(80, 160)) <= 4
    d = awkward(spark)
    a = quality.scored(d, m).collect()
    assert len(a) == 11 and all(x["score"] is None and not x["keep"] for x in a if x["doc_id"] in (1, 2, 3))
    assert quality.only_good(d, m).columns == d.columns
    assert quality.only_good(empty(spark), m).count() == 0
    blind = quality.train(empty(spark), labels.where("false"))
    assert {x["doc_id"] for x in quality.only_good(d, blind).collect()} == {None, 4, 5, 6, 7, 8, 9}


def test_non_negative_risk_separates():
    r = np.random.default_rng(0)
    p = r.normal(1, 1, (300, 2))
    u = np.vstack([r.normal(1, 1, (300, 2)), r.normal(-2, 1, (300, 2))])
    w, b = quality.nn_pu(p, u, 0.5)
    assert ((u @ w + b > 0)[:300]).mean() > 0.85 and ((u @ w + b > 0)[300:]).mean() < 0.1


def items_and_docs(r):
    items = [prose(r, n, 600) + ". " + prose(r, 10, 600) for n in (20, 30, 45)] + ["only four words here"]
    docs = [prose(r, 200, 600) for _ in range(20)]
    docs.append(prose(r, 90, 600) + " " + items[0] + " " + prose(r, 50, 600))
    w = items[1].split()
    docs.append(prose(r, 33, 600) + " " + " ".join(x for k, x in enumerate(w) if k % 8 != 3) + " " + prose(r, 20, 600))
    docs.append("so " + " ".join(x if k % 9 else "changed " + x for k, x in enumerate(items[2].split())))
    docs.append("Only four  words, here!")
    return items, docs


def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    items, docs = items_and_docs(r)
    b = spark.createDataFrame([*enumerate(items), (None, "x y"), (50, None), (51, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(table(spark, list(enumerate(docs))), b).collect()}
    assert {(20, 0), (21, 1), (22, 2), (23, 3)} <= got
    its = decontaminate.items_of(b)
    want = set()
    for d, t in enumerate(docs):
        h = decontaminate._item_words(t)
        for it in its:
            width = (-(-len(it.hashes) // decontaminate.BLOCK) + 1) * decontaminate.BLOCK
            if any(decontaminate.judged(it, h[k : k + width], 0.8, 0.6, 0.6) for k in range(0, len(h), decontaminate.BLOCK)):
                want.add((d, it.id))
    assert got <= want and len(got) >= 0.9 * len(want)
    d = awkward(spark)
    assert decontaminate.leaks(d, b).count() == 0 and decontaminate.leaks(empty(spark), b).count() == 0 and decontaminate.leaks(d, b.where("false")).count() == 0
    assert decontaminate.without_leaks(d, b).columns == d.columns and decontaminate.without_leaks(d, b).count() == d.count()


def test_no_leak_of_natural_texts_is_lost(spark):
    r = random.Random(12)
    size = 3000
    rank = [1 / (i + 2) for i in range(size)]
    text = lambda n: [f"w{i}" for i in r.choices(range(size), rank, k=n)]
    items = [text(n) for n in range(16, 61) for _ in range(2)]
    docs, planted = [], set()
    for i, it in enumerate(items):
        for share in (0.0, 0.2, 0.35):
            changed = [w if r.random() >= share else r.choice(text(1)) for w in it]
            dropped = [w for w in it if r.random() >= share]
            for part in [changed, dropped] if share else [it]:
                if not share:
                    planted.add((len(docs), i))
                base = text(300)
                at = r.randrange(len(base))
                docs.append(" ".join(base[:at] + part + base[at:]))
    b = spark.createDataFrame([(i, " ".join(it)) for i, it in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["common_words"], x["answer_words"]) for x in decontaminate.leaks(table(spark, list(enumerate(docs))), b).collect()}
    want = {}
    its = decontaminate.items_of(b)
    for d, t in enumerate(docs):
        h = decontaminate._item_words(t)
        for it in its:
            width = (-(-len(it.hashes) // decontaminate.BLOCK) + 1) * decontaminate.BLOCK
            found = [x for k in range(0, len(h), decontaminate.BLOCK) if (x := decontaminate.judged(it, h[k : k + width], 0.8, 0.6, 0.6))]
            if found:
                want[d, it.id] = max(found)
    assert planted <= set(want) and got == want


def test_multiset_bound():
    r = random.Random(3)
    its = [decontaminate.Item(i, tuple(r.randrange(1, 9) for _ in range(12)), 6) for i in range(5)]
    c = decontaminate._Chunk(its, np.zeros((5, 1)), 0.6)
    rows = np.array([[r.randrange(1, 12) for _ in range(20)] for _ in range(5)], np.uint64)
    got = c.shared(c.numbers(rows.ravel()).reshape(rows.shape), np.arange(5))
    for k, it in enumerate(its):
        own = rows[k].tolist()
        assert got[k] == sum(min(own.count(x), it.hashes.count(x)) for x in set(own))
        assert decontaminate.common_subsequence(it.hashes, own) <= got[k]


def test_common_subsequence():
    r = random.Random(9)
    for _ in range(100):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


def slow_bits(raw, model):
    """The coder of one text bit by bit."""
    n = len(raw)
    before, ctxs = lm_score.contexts(raw, np.array([0, n]))
    odds = model.odds.reshape(-1, 256)
    total = 0.0
    for lo in range(0, n, lm_score.SEGMENT):
        weights = np.full((lm_score._GATES, len(lm_score.ORDERS)), 0.3, np.float32)
        refine = (1 / (1 + np.exp(-(np.arange(lm_score._CELLS) - lm_score._CELLS // 2) / 2))).astype(np.float32)
        for i in range(lo, min(n, lo + lm_score.SEGMENT)):
            row = int(before[i]) << 8 | int(raw[i])
            for depth in range(model.tree.length[row]):
                node, bit = model.tree.node[row, depth], int(model.tree.bit[row, depth])
                x = np.array([odds[(o << lm_score.BITS) + c[i], node] for o, c in enumerate(ctxs)], np.float32) / np.float32(lm_score._SCALE)
                g = min(depth, lm_score._GATES - 1)
                dot = float(np.clip((x * weights[g]).sum(), -11, 11))
                cell = int(np.rint(np.clip(2 * dot, -16, 16))) + lm_score._CELLS // 2
                p = 1 / (1 + np.exp(-dot))
                a = float(refine[cell])
                total -= np.log2(1 - abs(bit - (p + a) / 2))
                weights[g] += x * np.float32((bit - p) * 0.02)
                refine[cell] += (bit - a) * 0.03
    return total


def test_context_mixing_against_one_bit_at_a_time(spark):
    r = random.Random(11)
    texts = [prose(r, 60, 40), prose(r, 200, 40), "", "é"]
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "id long, text string")
    model = lm_score.gather(d)
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(x) for x in raws])])
    got = lm_score.byte_bits(np.concatenate(raws), first, model)
    for k, raw in enumerate(raws):
        own = got[first[k] : first[k + 1]].sum()
        assert abs(own - (slow_bits(raw, model) if len(raw) else 0)) < 1e-2 * max(1, own)
    whole = lm_score._long_bits(raws[1], model, step=lm_score.SEGMENT)
    assert np.abs(whole - lm_score.byte_bits(raws[1], np.array([0, len(raws[1])]), model)).sum() < 1


def test_phrases_cut_all_bytes_alike():
    r = random.Random(13)
    shared = prose(r, 200)
    texts = [prose(r, 50) + " " + shared, "", "  \n", shared + "\t é", "one", None]
    start, doc, key = lm_score.phrases(pa.array(texts))
    raw = "".join(t or "" for t in texts).encode()
    parts = [raw[a:b] for a, b in zip(start, [*start[1:], len(raw)])]
    for k, t in enumerate(texts):
        assert b"".join(p for p, d in zip(parts, doc) if d == k) == (t or "").encode()
    of = {}
    for p, k in zip(parts, key.tolist()):
        assert of.setdefault(k, p) == p
    assert len(set(key[doc == 0].tolist()) & set(key[doc == 3].tolist())) >= 5


def test_gate_against_one_phrase_at_a_time():
    r = np.random.default_rng(3)
    for many, known in ((1, 0), (1, 1), (9, 4), (40, 40), (25, 1)):
        place = np.sort(r.choice(many, known, replace=False)).astype(float)
        cost, share = r.uniform(1, 200, known), r.uniform(1e-6, 1e-2, known)
        total, seen = 0.0, 0
        for k in range(many):
            gate = (seen + lm_score.KNOWN) / (k + lm_score.KNOWN + lm_score.NEW)
            if k in place:
                i = int(np.searchsorted(place, k))
                total += -np.log2(gate * share[i] + (1 - gate) * 2.0 ** -cost[i]) - cost[i]
                seen += 1
            else:
                total -= np.log2(1 - gate)
        assert abs(lm_score.gated(many, place, cost, share) - total) < 1e-6


def test_texts_that_occur_twice_are_known(spark):
    r = random.Random(14)
    texts = [prose(r, 150, 3000) for _ in range(60)]
    rows = list(enumerate([*texts, texts[7], texts[9] + " " + prose(r, 10, 3000)]))
    got = {x["doc_id"]: x["bits_per_byte"] for x in lm_score.bits_per_byte(table(spark, rows)).collect()}
    once = [got[k] for k in range(60) if k not in (7, 9)]
    assert all(got[k] < 0.5 * min(once) for k in (7, 9, 60, 61))
    # a phrase that only the text itself repeats isn't known
    own = {x["doc_id"]: x["bits_per_byte"] for x in lm_score.bits_per_byte(table(spark, [*enumerate(texts), (99, texts[0].replace("w1", "v1") * 2)])).collect()}
    assert own[99] > 0.5 * min(once)


def test_familiar_text_takes_fewer_bits(spark):
    r = random.Random(12)
    model = lm_score.gather(spark.createDataFrame([(i, prose(r, 80, 50)) for i in range(60)], "id long, text string"))
    rate = lambda t: lm_score.byte_bits(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), model).mean()
    assert rate(prose(r, 80, 50)) < 3 < rate("".join(chr(33 + r.randrange(90)) for _ in range(400)))


def test_scores_of_awkward_tables(spark):
    got = {x["doc_id"]: x for x in lm_score.bits_per_byte(awkward(spark)).collect()}
    assert len(got) == 9 and lm_score.bits_per_byte(awkward(spark)).count() == 11
    assert all(got[i]["bits"] == 0.0 and got[i]["bits_per_byte"] is None for i in (1, 2)) and got[3]["bytes"] == 4
    assert lm_score.bits_per_byte(empty(spark)).count() == 0


def test_code_is_prefix_free():
    tree = lm_score.Tree.of(np.random.default_rng(0).integers(0, 50, (256, 256)).astype(float))
    codes = ["".join(map(str, tree.bit[i, : tree.length[i]])) for i in range(256)]
    codes.sort()
    assert all(not b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert isinstance(pa.array([1]), pa.Array)
