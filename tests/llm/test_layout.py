"""Packing, sharding, chats and the pipeline."""

import base64
import collections
import heapq
import importlib
import random

import numpy as np
import pyarrow as pa
import tiktoken

from sheaf.llm import chat, packing, sharding

from .data import awkward, empty, prose, table


def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.TOKENIZER, "rb"))}
    return tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_tokenizer(monkeypatch):
    e = tokenizer()
    r = random.Random(1)
    texts = ["", " ", "\n\n", " a", "a ", "it's  two\n\n three\t\tfour ", "Ünï 世界 x", "\u2003em\u2003 space ", None] + ["".join(r.choice("ab1' \n\té.,世\u00a0 ") for _ in range(r.randrange(40))) for _ in range(400)]
    monkeypatch.setattr(packing.Tokens, "POOL", 500)
    t = packing.Tokens(packing.TOKENIZER)
    for _ in range(2):
        got = [flat[at[k] : at[k + 1]].tolist() for part in (texts[:100], texts[100:], ["", None]) for lo, hi, flat, at in t.of(pa.array(part)) for k in range(hi - lo)]
        assert got == [e.encode_ordinary(x or "") for x in [*texts, "", None]]


def brute_pack(docs, capacity, most):
    open_, done, began = [], [], 0
    for i, n in docs:
        at = 0
        while n >= capacity:
            done.append([(i, at, capacity)])
            at, n = at + capacity, n - capacity
        if not n:
            continue
        fits = [w for w in open_ if w[0] >= n]
        if fits:
            w = min(fits, key=lambda w: (w[0], w[1]))
        else:
            if len(open_) >= most:
                full = min(open_, key=lambda w: (w[0], w[1]))
                open_.remove(full)
                done.append(full[2])
            w = [capacity, began, []]
            began += 1
            open_.append(w)
        w[0] -= n
        w[2].append((i, at, n))
        if not w[0]:
            open_.remove(w)
            done.append(w[2])
    return done + [w[2] for w in open_]


def windows(df):
    return sorted(tuple(zip(x["doc_ids"], x["starts"], x["lengths"], strict=True)) for x in df.collect())


def test_packing_against_brute_force(spark):
    r = random.Random(2)
    e = tokenizer()
    texts = [prose(r, r.choice([1, 2, 8, 16, 17, 70, r.randrange(1, 20)])) for i in range(200)]
    got = windows(packing.pack(table(spark, list(enumerate(texts))).coalesce(1), capacity=64, open_windows=4))
    first = brute_pack([(i, len(e.encode_ordinary(t))) for i, t in enumerate(texts)], 64, 4)
    # what is open at the end is packed once more, by its first piece
    done, open_ = first[:-4], first[-4:]
    assert set(map(tuple, done)) <= set(got) and sorted(p for w in got for p in w) == sorted(p for w in first for p in w)
    assert len(done) + 1 <= len(got) <= len(first) and sum(map(len, got)) == sum(map(len, done + open_))


def test_windows_decode_to_the_texts(spark):
    r = random.Random(3)
    e = tokenizer()
    texts = [prose(r, r.randrange(1, 60)) + r.choice(["", "\n", "  é\u2003"]) for _ in range(300)] + [prose(r, 3000)]
    out = packing.pack(table(spark, list(enumerate(texts))).repartition(7), capacity=64, open_windows=4, fan_in=3)
    rows = out.collect()
    parts = {}
    for x in rows:
        assert x["tokens"] == sum(x["lengths"]) == len(x["token_ids"]) <= 64
        at = 0
        for i, s, n in zip(x["doc_ids"], x["starts"], x["lengths"], strict=True):
            parts.setdefault(i, []).append((s, x["token_ids"][at : at + n]))
            at += n
    assert [e.decode([t for _, ids in sorted(parts[i]) for t in ids]) for i in range(len(texts))] == texts
    assert len(rows) <= 1.15 * -(-sum(x["tokens"] for x in rows) // 64)


def test_packing_of_awkward_tables(spark):
    out = packing.pack(awkward(spark)).collect()
    ids = [i for x in out for i in x["doc_ids"]]
    assert set(ids) == {3, 4, 5, 6, 7, 8, 9} and ids.count(6) == 2
    assert packing.pack(empty(spark)).count() == 0


def test_sharding_against_brute_force(spark):
    r = random.Random(4)
    texts = [prose(r, r.randrange(1, 60)) for _ in range(60)]
    texts += texts[:15] + [None, "", None]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: (x["part"], x["shard"]) for x in sharding.shard_documents(table(spark, [*rows, (None, "z")]), shards=5).collect()}
    part, size = {}, {}
    for i, t in rows:
        p = part.setdefault(t or "", i)
        size[p] = size.get(p, 0) + len(t or "")
    # which groups of one size go where is free; how many of each size a shard gets isn't
    heap = [(0, k) for k in range(5)]
    want = collections.Counter()
    for p in sorted(size, key=lambda p: -size[p]):
        load, k = heapq.heappop(heap)
        want[size[p], k] += 1
        heapq.heappush(heap, (load + size[p], k))
    assert {i: p for i, (p, _) in got.items()} == {i: part[t or ""] for i, t in rows}
    where = {p: {got[i][1] for i, t in rows if part[t or ""] == p} for p in size}
    assert all(len(w) == 1 for w in where.values())
    assert collections.Counter((size[p], *w) for p, w in where.items()) == want
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert sharding.shard_documents(awkward(spark)).count() == 11


def test_runs_are_dealt_as_one_by_one():
    r = random.Random(9)
    for _ in range(200):
        load = np.array([r.randrange(50) for _ in range(r.randrange(1, 9))])
        size, many = r.randrange(0, 12), r.randrange(1, 60)
        want = np.bincount(sharding.order_in_run(load, size, many), minlength=len(load))
        new = load.copy()
        assert sharding.dealt(new, size, many).tolist() == want.tolist()
        assert new.tolist() == (load + want * size).tolist()


def test_chats_against_brute_force(spark):
    r = random.Random(5)
    convs = {}
    for c in range(40):
        if convs and r.random() < 0.6:
            base = convs[r.choice(list(convs))]
            convs[c] = base[: r.randrange(1, len(base) + 1)] + [("user", f"t{r.randrange(4)}")] * r.randrange(2)
        else:
            convs[c] = [(r.choice(["user", "assistant"]), f"t{r.randrange(4)}") for _ in range(r.randrange(1, 5))]
    rows = [(c, n, role, text, "x") for c, turns in convs.items() for n, (role, text) in enumerate(turns)]
    t = spark.createDataFrame(rows + rows[:3] + [(None, 0, "user", "lost", "x")], "conv_id long, turn long, role string, text string, conv string")
    got = {x["conv_id"]: x["turns"] for x in chat.chat_texts(t).collect()}
    want = {}
    for c, w in convs.items():
        longer = any(len(v) > len(w) and v[: len(w)] == w for v in convs.values())
        if not longer and c == min(k for k, v in convs.items() if v == w):
            want[c] = len(w)
    assert got == want


def test_chat_markers_nulls_and_empty(spark):
    t = spark.createDataFrame([(1, None, None, "a <|end|> b"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert chat.chat_texts(t).first()["chat"] == "<|user|>\na < |end| > b<|end|>\n<|assistant|>\n<|end|>\n"
    long = "word " * 50_000
    odd = spark.createDataFrame([(5, 1, "user|>x", long, "a", "b", "c")], "conv_id long, turn long, role string, text string, conv string, place string, size string")
    assert chat.chat_texts(odd).first()["chat"] == f"<|user| >x|>\n{long}<|end|>\n"
    assert chat.chat_texts(t.where("false")).count() == 0


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, d).write.parquet(out)
        after = spark.read.parquet(out)
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == columns and 0 < after.count() <= docs.count()
            assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            docs = after
    # the windows give the texts of the last stage before them back, token by token
    e = tokenizer()
    parts = {}
    for x in after.collect():
        at = 0
        for i, s, n in zip(x["doc_ids"], x["starts"], x["lengths"], strict=True):
            parts.setdefault(i, []).append((s, x["token_ids"][at : at + n]))
            at += n
    assert {i: e.decode([t for _, ids in sorted(p) for t in ids]) for i, p in parts.items()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    for name, docs in (("some", awkward(spark)), ("none", empty(spark))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x"), (2, "nothing of this is anywhere in those few texts at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        rows = pipeline.run(spark, d).collect()
        held = {i for x in rows for i in x["doc_ids"]}
        assert held <= {4, 6, 7, 8, 9} and ({4, 7} <= held if name == "some" else not rows)
        assert all(len(x["token_ids"]) == sum(x["lengths"]) for x in rows)
