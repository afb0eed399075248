"""Near copies, repeated passages and embeddings against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import embeddings, ngram_join, repeats, storage

from .data import awkward, empty, prose, table


def grams(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_classes(rows, least=0.5):
    """(id, class, links) of all rows, by all pairs of texts."""
    rows = {(i, t or "") for i, t in rows if i is not None}
    key = lambda t: tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    ids = {}
    for i, t in rows:
        if key(t):
            ids.setdefault(key(t), set()).add(i)
    keys = sorted(ids)
    sets = [grams(" ".join(k)) for k in keys]
    edges = [(x, y) for x in range(len(keys)) for y in range(x) if len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y])]
    root = list(range(len(keys)))
    for _ in keys:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    first = {}
    for x, k in enumerate(keys):
        first[root[x]] = min(first.get(root[x], 10**9), *ids[k])
    links = [sum(x in e for e in edges) for x in range(len(keys))]
    at = {k: x for x, k in enumerate(keys)}
    return {(i, first[root[at[key(t)]]], links[at[key(t)]]) if key(t) else (i, i, 0) for i, t in rows}


def edited(r, base, rate):
    return [w if r.random() >= rate else f"x{r.randrange(900)}" for w in base]


def test_near_classes_against_brute_force(spark):
    r = random.Random(2)
    docs = []
    for _ in range(25):
        base = prose(r, r.randrange(20, 120)).split()
        docs += [base, *(edited(r, base, rate) for rate in (0.01, 0.03, 0.06, 0.1)), base]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {tuple(x) for x in ngram_join.near_classes(table(spark, rows)).collect()}
    want = brute_classes(rows)
    assert len(got & want) >= 0.98 * len(want) and len(got) == len(rows)


def test_links_that_buckets_miss_are_found(spark):
    # one tree with a long prefix finds few of the pairs near the threshold
    r = random.Random(9)
    docs = []
    for _ in range(12):
        base = prose(r, r.randrange(4, 120)).split()
        docs += [base, edited(r, base, 0.05), edited(r, base, 0.1), base + prose(r, len(base) // 2).split()]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = brute_classes(rows)
    for crowd in (1 << 14, 3):
        assert {tuple(x) for x in ngram_join.near_classes(table(spark, rows), trees=1, deep=5, shallow=4, crowd=crowd).collect()} == want


def test_crowded_classes_are_exact(spark):
    # one group far larger than a block, tight and loose members, in buckets that are cut into parts
    r = random.Random(3)
    base = prose(r, 100).split()
    other = base[:70] + prose(r, 30).split()
    docs = [base] * 3 + [edited(r, base, 0.02) for _ in range(60)] + [edited(r, other, 0.02) for _ in range(30)] + [edited(r, base, 0.12) for _ in range(40)] + [prose(r, 40).split() for _ in range(20)]
    r.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = brute_classes(rows)
    got = {tuple(x) for x in ngram_join.near_classes(table(spark, rows), block_docs=12, crowd=30, rounds=2).collect()}
    assert got == want


def test_comparisons_of_a_crowd_grow_with_it(spark, monkeypatch):
    sent = []
    whole = ngram_join._with_text
    monkeypatch.setattr(ngram_join, "_with_text", lambda docs, units: sent.append(units.count()) or whole(docs, units))
    r = random.Random(4)
    base = prose(r, 100).split()
    counts = []
    for n in (60, 240):
        rows = [(i, " ".join(edited(r, base, 0.01))) for i in range(n)]
        sent.clear()
        got = ngram_join.near_classes(table(spark, rows), block_docs=16).collect()
        assert len(got) == n and all(x["class_id"] == 0 for x in got)
        counts.append(sum(sent))
    assert counts[1] < 5 * counts[0]  # all pairs of blocks would be 16 times as many


def test_near_classes_of_awkward_tables(spark):
    got = {tuple(x) for x in ngram_join.near_classes(awkward(spark)).collect()}
    assert {(4, 4, 0), (5, 4, 0)} <= got and {(i, i, 0) for i in (1, 2, 3, 6, 7, 8, 9)} <= got and len(got) == 9
    assert ngram_join.near_classes(empty(spark)).count() == 0
    d = awkward(spark)
    left = ngram_join.without_near_copies(d)
    assert left.columns == d.columns
    ids = [x["doc_id"] for x in left.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 2 and 5 not in ids and ids.count(6) == 2 and len(ids) == d.count() - 1
    assert ngram_join.without_near_copies(empty(spark)).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    assert [ngram_join.depth_for(j, 32, 5, 3, 0.98) for j in (0.9, 0.7, 0.5)] == [5, 5, 3]


def brute_spans(rows, least=50):
    seen, windows = {}, []
    for i, t in sorted(set(rows)):
        w = re.split(r"[\t-\r\x1c-\x20]+", t or "")
        w = [x for x in w if x]
        for p in range(len(w) - least + 1):
            key = tuple(w[p : p + least])
            windows.append((i, hash(t), p, key))
            seen.setdefault(key, []).append((i, p))
    out = {}
    for i, t, p, key in windows:
        if len(seen[key]) > 1:
            out.setdefault((i, t, min(seen[key]) != (i, p)), []).append(p)
    found = set()
    for (i, _, again), places in out.items():
        places.sort()
        begin = last = places[0]
        for p in places[1:] + [10**12]:
            if p > last + least:
                found.add((i, begin, last + least, again))
                begin = p
            last = p
    return found


def test_repeats_against_brute_force(spark):
    r = random.Random(4)
    shared = [prose(r, n) for n in (50, 49, 70, 200)]
    rows = [(i, " ".join(r.choice([prose(r, r.randrange(0, 60)), r.choice(shared)]) for _ in range(r.randrange(1, 6)))) for i in range(40)]
    rows += [(40, " ".join(["again"] * 130)), (41, "same same " * 60)]
    for crowd in (repeats.CROWD, 3):  # in one place, and by aggregation
        got = {tuple(x) for x in repeats.spans(table(spark, rows), crowd=crowd).collect()}
        assert got == brute_spans(rows)


def test_crowded_anchors_join_the_texts_once(spark):
    r = random.Random(6)
    shared = prose(r, 120)
    rows = [(i, f"{prose(r, 30)} {shared}" if i % 3 else " ".join(["again"] * 70) + " " + shared) for i in range(9)]
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    docs = spark.sparkContext.parallelize(rows, 2).map(read).toDF("doc_id long, text string")
    assert {tuple(x) for x in repeats.spans(docs, crowd=3).collect()} == brute_spans(rows)
    assert seen.value == 2 * len(rows)  # for anchors, and for the join


def test_repeats_of_awkward_tables(spark):
    d = awkward(spark)
    assert {tuple(x) for x in repeats.spans(d).collect()} == {(4, 0, 80, False), (5, 0, 80, True)}
    assert repeats.spans(empty(spark)).count() == 0
    left = repeats.without_repeats(d)
    assert left.columns == d.columns and left.count() == d.count() - 1 and 5 not in [x["doc_id"] for x in left.collect()]


def test_cut_texts_lose_the_repeat_only(spark):
    r = random.Random(8)
    p = prose(r, 60)
    rows = [(1, f"first {p} end"), (2, f"other start {p} and a tail")]
    left = {x["doc_id"]: (x["text"], x["n_chars"]) for x in repeats.without_repeats(table(spark, rows)).collect()}
    assert left[1][0] == rows[0][1]
    assert left[2][0].split() == "other start and a tail".split() and left[2][1] == len(left[2][0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_suffix_mergesort(values):
    h = np.concatenate([np.array(values, np.uint64), np.arange(100, 108, dtype=np.uint64)])
    s = repeats.Suffixes(h, 8)
    order = repeats.merge_sorted(s, np.arange(len(values)), np.zeros(len(values), np.int64))
    assert [tuple(h[i : i + 8]) for i in order] == sorted(tuple(h[i : i + 8]) for i in range(len(values)))


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((120, 16))
    v = np.vstack([v, v[:60] + r.standard_normal((60, 16)) * r.uniform(0.02, 0.35, (60, 1)), v[0] + r.standard_normal((90, 16)) * r.uniform(0.02, 0.3, (90, 1)), v[:5]])
    v = v.astype(np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    n = len(v) - 5
    link = (unit[:n] @ unit[:n].T >= 0.95) & ~np.eye(n, dtype=bool)
    root = np.arange(n)
    for _ in range(n):
        root = np.array([min(root[i], *root[link[i]]) if link[i].any() else root[i] for i in range(n)])
    want = {(i, int(root[i]), int(link[i].sum())) for i in range(n)} | {(n + k, int(root[k]), int(link[k].sum())) for k in range(5)}
    t = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, v int")
    for more in ({}, {"crowd": 40, "block": 16, "rounds": 2}):
        got = {tuple(x) for x in embeddings.vector_classes(t, **more).collect()}
        assert len(got) == len(v) and got == want


def test_awkward_vectors(spark):
    rows = [(None, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.01]), (10, [0.0, 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in embeddings.vector_classes(t).collect()} == {(7, 7, 1), (8, 7, 1), (9, 7, 1), (10, 10, 0)}
    assert embeddings.vector_classes(t.where("false")).count() == 0


def test_estimates_are_unbiased():
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = embeddings.encode(x, embeddings.rotation(64), np.arange(60))
    mean, half = embeddings.estimate(*code, slice(0, 60), slice(0, 60), 4.0)
    off = ~np.eye(60, dtype=bool)
    assert abs((mean - x @ x.T)[off].mean()) < 0.01 and (np.abs(mean - x @ x.T) <= half)[off].mean() > 0.999


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (None, 1), (3, 1)], "a long, b long")
    assert {tuple(x) for x in storage.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}


def test_components_of_many_edges(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(1000, 1090)] + [(5, i) for i in range(6, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    linked = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
    e = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for alone in (storage.ALONE, 0):  # in one task, and in rounds
        assert {tuple(x) for x in storage.connected_components(e, alone=alone).collect()} == {(x, root[x]) for x in linked}


def test_broadcast_rows_count_as_they_are_in_memory():
    # a million ids are 8 MB as such, and 200 MB and more in a broadcast table, which the driver builds
    assert storage.small_enough(20_000, 8) and not storage.small_enough(1_000_000, 8)


def _in_one_bucket(spark, kinds, count):
    """Texts of one bucket in every tree, by label in an order that mixes ``kinds`` kinds of sketches."""
    r = np.random.default_rng(7)
    sketches = [[int(x) for x in r.integers(-(2**63), 2**63, 4)] for _ in range(kinds)]
    rows = [(i, *sketches[i % kinds], bytes(8), int(i).to_bytes(8, "big")) for i in range(count)]
    return spark.createDataFrame(rows, "node long, k1 long, k2 long, k3 long, k4 long, keys binary, labels binary")


def _groups(nodes, crowd):
    links = ngram_join.forest_links(nodes, 1, 5, 3, 0.5, 0.98, crowd, [])
    return {x[0]: x[1] for x in storage.connected_components(links, *links.columns).collect()}


def test_all_texts_of_a_bucket_are_candidates(spark):
    # alike texts are seven places apart, in a bucket of a few texts and in one of many
    for count in (14, 84):
        assert _groups(_in_one_bucket(spark, 7, count), 1 << 14) == {i: i % 7 for i in range(count)}


def test_crowded_buckets_lose_no_candidates(spark):
    found = _groups(_in_one_bucket(spark, 7, 90), 20)
    assert len(found) == 90 and all(found[i] == found[i % 7] for i in range(90))


def test_bounds_of_rounded_vectors_always_hold():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 64)) * r.uniform(0.1, 3, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, half = embeddings.barely(*embeddings.rounded(x), slice(0, 150), slice(150, 300))
    assert (np.abs(mean - x[:150] @ x[150:].T) <= half).all() and half.max() < 0.05


def test_unlike_vectors_of_a_bucket_are_no_group():
    # cosines of about 0.75, which confidence bounds alone leave in
    r = np.random.default_rng(4)
    v = r.standard_normal(64) * 1.7 + r.standard_normal((200, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert np.triu(unit @ unit.T, 1).max() < 0.9
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(200)), pa.array(np.arange(200)), pa.array(list(v), pa.list_(pa.float64()))], names=["node", "id", "v"])
    one = next(embeddings._code_rows(64)(iter([rows])))
    one = one.append_column("band", pa.array(np.zeros(200, np.int32))).append_column("bucket", pa.array(np.zeros(200, np.int64)))
    assert not list(embeddings._bucket_links(64, 0.95, 4.0)(iter([one])))


def _prefix_rows(texts, least=0.5):
    """Rows of the prefixes of texts, sorted as ``_shared`` and ``_across`` want them; each text is its own node and group."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = pa.Table.from_batches(list(ngram_join._prefixes(3, least, np.zeros(1 << ngram_join.CELLS, np.uint16))(iter([batch]))))
    rows = rows.sort_by([("key", "ascending"), ("s1", "ascending")]).combine_chunks()
    kept = pa.Table.from_batches(list(ngram_join._shared(least)(iter(rows.to_batches()))))
    seq = ngram_join._sets(pa.array(texts), 3)[1].tolist()
    node = pa.array([seq.index(x) for x in kept["s1"].to_pylist()], pa.int64())
    return kept.append_column("node", node).append_column("group", node)


def _candidates(texts, least=0.5):
    pairs = [p.to_pylist() for p in ngram_join._across(least, 1 << 14)(iter(_prefix_rows(texts, least).combine_chunks().to_batches()))]
    found = {}
    for p in sum(pairs, []):
        k, rest, need = found.get((p["u"], p["v"]), (0, p["rest"], p["need"]))
        found[p["u"], p["v"]] = (k + p["k"], min(rest, p["rest"]), min(need, p["need"]))
    return {uv for uv, (k, rest, need) in found.items() if k + rest >= need}


def test_places_in_prefixes_lose_no_link():
    # few words, so that most pairs share n-grams, texts of all sizes, and many coefficients about the threshold
    r = random.Random(12)
    texts = []
    for _ in range(40):
        base = prose(r, r.randrange(3, 400), 12 if r.random() < 0.5 else 400).split()
        texts += [" ".join(x) for x in (base, edited(r, base, 0.03), edited(r, base, 0.1), edited(r, base, 0.14), base[: len(base) // 2 + 2], base + prose(r, len(base) // 2).split())]
    texts = list(dict.fromkeys(texts))
    sets = [grams(t) for t in texts]
    for least in (0.5, 0.8):
        want = {(x, y) for y in range(len(texts)) for x in range(y) if len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y])}
        assert len(want) > 20 and want <= _candidates(texts, least)


def test_texts_of_unlike_size_are_no_candidates_by_one_n_gram():
    # each shares one line with the others, and has half or twice as many words; n-grams come by their hashes
    r = random.Random(13)
    texts = [f"{prose(r, 40 * (1 + k % 2), 10**6)} all rights are reserved {prose(r, 40 * (1 + k % 2) - 2, 10**6)}" for k in range(24)]
    assert not _candidates(texts)


def test_joins_of_any_size_take_no_broadcast(spark, monkeypatch):
    # Spark would broadcast by the bytes of files, of which rows take many times as much in the driver's memory
    plans = []
    whole = storage.stash
    monkeypatch.setattr(storage, "stash", lambda df, keep=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, keep))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    r = random.Random(11)
    base = prose(r, 100).split()
    rows = [(i, " ".join(edited(r, base, 0.02))) for i in range(20)] + [(i, prose(r, 40)) for i in range(20, 25)]
    got = {tuple(x) for x in ngram_join.near_classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows)
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
