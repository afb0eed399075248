import io

import pytest
from pyspark.sql import functions as F

from sheaf import cli, schema
from sheaf.functions import similarity
from sheaf.functions import text as X
from sheaf.operators import classify, evaluate, merge, model, pages, prompts, split, tables
from sheaf.plans.documents import Documents
from sheaf.sources import files, mime


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_chunks_against_python(spark):
    texts = ["a b c\nd e f\ng", "", "one two three four five six seven eight nine ten eleven twelve", "x\n\n\ny"]
    got = rows(pages.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6, separator="\n").select("doc_id", "chunk_no", "content"), "doc_id", "chunk_no")
    want = []
    for i, t in enumerate(texts):
        done, now = [], None
        for p in (q.strip() for q in t.split("\n")):
            if not p:
                continue
            if now is not None and X.count_tokens(now) + X.count_tokens(p) + 1 <= 6:
                now += "\n\n" + p
            else:
                done += [now] if now is not None else []
                now = p
        done += [now] if now is not None else []
        want += [(i, k + 1, c) for k, c in enumerate(done)]
    assert got == want


def test_page_selection(spark):
    p = spark.createDataFrame([(1, n, f"p{n}") for n in (1, 2, 3)], "doc_id int, page_no int, content string")
    assert [r["content"] for r in pages.selected(p, [3, 1, 3]).orderBy("pos").collect()] == ["p3", "p1", "p3"]
    with pytest.raises(ValueError):
        pages.selected(p, [0])


def test_lazy_groups(spark):
    v = spark.createDataFrame([(1, 1, True, "A", "A"), (1, 2, False, "A", "B"), (1, 3, True, "B", "B"), (1, 4, False, "B", None), (2, 1, False, "C", None)], "doc int, page_no int, same boolean, c1 string, c2 string")
    assert rows(split.lazy_groups(v, "doc"), "doc", "group_no") == [(1, 1, "A", [1, 2]), (1, 2, "B", [3, 4]), (2, 1, "C", [1])]


def test_failed_verdict_is_same_document(spark):
    p = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc int, page_no int, content string")
    v = split.verdicts(p, F.lit(None).cast("boolean"), F.lit("A"), F.lit("A"), "doc")
    assert rows(split.lazy_groups(v, "doc"), "doc") == [(1, 1, "A", [1, 2])]


def test_eager_groups(spark):
    a = spark.createDataFrame([(1, '{"groupOfDocuments": [{"pages": [1], "classification": "A"}, {"pages": [2, 3], "classification": "B"}]}', 3), (2, "oops", 2)], "doc int, raw string, num_pages int")
    assert rows(split.eager_groups(a, "doc"), "doc", "group_no") == [(1, 1, "A", [1]), (1, 2, "B", [2, 3]), (2, 1, "unknown", [1, 2])]


def test_votes(spark):
    v = spark.createDataFrame([(1, 0, 0, "a", 5), (1, 0, 1, "b", 5), (1, 1, 0, "c", 9), (1, 1, 1, "c", 8), (2, 0, 0, "a", 1), (2, 0, 1, None, 1)], "doc int, layer int, model_ord int, name string, confidence int")
    assert rows(classify.cascade(v, "doc", classify.CONSENSUS), "doc") == [(1, 1, "c", 9, "ok"), (2, None, None, None, "unresolved")]
    assert rows(classify.vote(v.where("doc = 1"), ["doc", "layer"], classify.HIGHER_ORDER), "layer") == [(1, 0, "a", 5), (1, 1, "c", 9)]
    assert classify.vote(v, ["doc", "layer"], classify.CONSENSUS_WITH_THRESHOLD, 9).count() == 0
    with pytest.raises(ValueError):
        classify.vote(v, ["doc"], classify.CONSENSUS_WITH_THRESHOLD, 11)


def test_layers_ask_only_about_open_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "sure"), (2, "open")], "doc int, content string")
    seen = []

    def store(df):
        path = str(tmp_path / str(len(seen)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    def layer(names):
        def ask(d):
            seen.append({r["doc"] for r in d.collect()})
            return d.select("doc", F.explode(F.array(*[F.struct(F.lit(i).alias("model_ord"), F.when(F.col("content") == "sure", "a").otherwise(n).alias("name"), F.lit(5).alias("confidence")) for i, n in enumerate(names)])).alias("v")).select("doc", "v.*")

        return ask

    out = classify.through_layers(docs, [layer(["x", "y"]), layer(["z", "z"])], "doc", classify.CONSENSUS, None, store)
    assert rows(out.select("doc", "name", "layer"), "doc") == [(1, "a", 0), (2, "z", 1)]
    assert seen == [{1, 2}, {2}]


def test_scalar_merge_and_resolution(spark):
    p = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, None, 2.0), (1, 3, "a", 1.0), (2, 1, None, None)], "doc int, page int, s string, n double")
    m = merge.scalars(p, ["doc"], ["s", "n"], "page", ("s",))
    got = {r["doc"]: r for r in m.collect()}
    assert got[1]["s"]["value"] == "a" and not got[1]["s"]["is_conflict"]
    assert got[1]["n"]["candidates"] == [1.0, 2.0] and got[1]["n"]["value"] is None
    assert got[2]["s"]["value"] == "" and got[2]["n"]["value"] is None
    assert rows(merge.settled(m, ["doc"], ["s", "n"]), "doc") == [(1, "a", 1.0), (2, "", None)]
    assert rows(merge.in_conflict(m, ["doc"], ["s", "n"]), "doc") == [(1, "n", ["1.0", "2.0"])]
    fixed = merge.resolved(m, spark.createDataFrame([(1, "n", "2.0"), (1, "zz", "9")], "doc int, field string, value string"), ["doc"], ["s", "n"])
    assert rows(fixed, "doc") == [(1, "a", 2.0), (2, "", None)]


def test_item_merge(spark):
    item = "array<struct<name:string,gdp:double,parts:array<int>>>"
    p = spark.createDataFrame([(1, 1, [("X", None, [1]), (None, 5.0, None)]), (1, 2, [("x", 2.0, [2]), (None, 6.0, [3])])], f"doc int, page int, items {item}")
    got = rows(merge.items(p, ["doc"], "items", "page", ["name", "gdp", "parts"], ("parts",)), "place")
    assert got == [(1, 1, "X", 2.0, [1, 2]), (1, 2, None, 5.0, []), (1, 3, None, 6.0, [3])]


def test_metrics(spark):
    r = spark.createDataFrame([(1, "a", True, True), (2, "a", False, True), (3, "a", False, False), (1, "b", False, False)], "doc int, field string, matched boolean, present boolean")
    m = {x["field"]: x for x in evaluate.field_metrics(r, spark.createDataFrame([("a",), ("b",), ("c",)], "field string")).collect()}
    assert (m["a"]["tp"], m["a"]["fp"], m["a"]["fn"], m["a"]["precision"], m["a"]["recall"]) == (1, 1, 1, 0.5, 0.5)
    assert m["b"]["f1"] == 0.0 and m["c"]["total"] == 0
    assert evaluate.document_accuracy(r, spark.createDataFrame([(1,), (9,)], "doc int"), "doc").first()["accuracy"] == 0.5


def test_tables(spark):
    t = spark.createDataFrame([(1, 1, 2, "b"), (1, 2, 1, "c")], "t int, r int, c int, x string")
    assert tables.built_tables(t, ["t"], "r", "c", "x").first()["rows"] == [["", "b"], ["c", ""]]
    g = spark.range(1).select(tables.markdown_table(F.array(F.array(F.lit("h"), F.lit("k")), F.array(F.lit("1"), F.lit(None).cast("string")))).alias("m")).first()["m"]
    assert g == "| h | k |\n| --- | --- |\n| 1 |  |"


def test_batch(spark):
    lines = spark.createDataFrame([('{"custom_id":"1","response":{"body":{"choices":[{"message":{"content":"{\\"a\\":1}"}}]}}}',), ('{"custom_id":"2","response":{"body":{"choices":[{"message":{"content":"no"}}]}}}',)], "line string")
    got = {r["custom_id"]: r for r in prompts.batch_results(lines, schema.contract("a INT")).collect()}
    assert got["1"]["parsed"]["a"] == 1 and got["2"]["status"] == "unparsed"


def test_contracts(spark):
    class Line:
        description: str
        amount: float | None

    class Invoice:
        number: str
        lines: list[Line]

    s = schema.from_annotations(Invoice)
    assert s.simpleString() == "struct<number:string,lines:array<struct<description:string,amount:double>>>"
    assert "  amount" in schema.rendered(s)
    r = spark.createDataFrame([('{"a": 1}',), ('{"a": "zz"}',), ("{bad",), (None,)], "raw string").select(schema.read(F.col("raw"), schema.contract("a INT")).alias("r"))
    assert [x["r"]["valid"] for x in r.collect()] == [True, False, False, False]


def test_strategies_and_errors(spark):
    p = spark.createDataFrame([(1, 1, "Name: Ann"), (1, 2, "Age: 30"), (2, 1, "Name: Bo\nfail")], "doc_id int, page_no int, content string")
    c = schema.contract("name STRING, age STRING")
    b = model.RegexBackend({"name": r"^Name: (\w+)", "age": r"^Age: (\d+)"})
    assert rows(Documents(p).extract(b, c).select("doc_id", "name", "age"), "doc_id") == [(1, "Ann", "30"), (2, "Bo", None)]
    assert rows(Documents(p).extract(b, c, model.PAGINATE), "doc_id") == [(1, "Ann", "30"), (2, "Bo", "")]

    def failing(prompt):
        if "fail" in prompt:
            raise RuntimeError("no")
        return b(prompt)

    got = {r["doc_id"]: r for r in Documents(p).extract(failing, c).collect()}
    assert got[2]["error"] == "RuntimeError: no" and not got[2]["schema_valid"] and got[1]["schema_valid"]


def test_continuations():
    parts = iter(['```json{"a": [1,', " 2]}```"])
    assert model.continued(lambda p: next(parts))("x") == '{"a": [1,2]}'
    with pytest.raises(ValueError):
        model.continued(lambda p: "{")("x")
    assert model.FallbackBackend(lambda p: 1 / 0, lambda p: "ok")("x") == "ok"


def test_cache(spark):
    p = spark.createDataFrame([("a",), ("b",)], "prompt string")
    c = p.where("prompt = 'a'").select(F.sha2("prompt", 256).alias("prompt_hash"), F.lit("A").alias("raw"))
    hit, miss = model.cached(p, c)
    assert [r["raw"] for r in hit.collect()] == ["A"] and [r["prompt"] for r in miss.collect()] == ["b"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one\n\n two ", encoding="utf-8")
    (tmp_path / "b.csv").write_text('x,"y, z"\n\n1,2\n', encoding="utf-8")
    (tmp_path / "c.html").write_text("<p>Hi</p>", encoding="utf-8")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "labels.json").write_text('{"a.txt": {"n": 1}}', encoding="utf-8")
    assert [r["content"] for r in files.load(spark, str(tmp_path / "a.txt"), separator="\n\n").orderBy("page_no").collect()] == ["one", "two"]
    assert files.load(spark, str(tmp_path / "b.csv")).first()["content"] == "x | y, z\n1 | 2"
    assert files.load(spark, str(tmp_path / "c.html")).first()["content"] == "Hi"
    assert files.read_binary(spark, str(tmp_path / "d.pdf")).first()["kind"] == "pdf"
    assert files.read_labels(spark, str(tmp_path / "labels.json")).first()["expected"] == '{"n":1}'
    with pytest.raises(files.MissingCodec):
        files.load(spark, str(tmp_path / "d.pdf"))
    with pytest.raises(ValueError):
        files.read_data(spark, [{"wrong_key": "value"}])
    assert dict(mime.MIME)["pdf"] == "application/pdf"


def test_csv_of_many_columns(spark, tmp_path):
    cells = [[f"{r}-{i}" for i in range(n)] for r, n in enumerate((3, 64, 65, 300))]
    (tmp_path / "wide.csv").write_text("\n".join(",".join(c) for c in cells) + '\n"a ""b, c' + "d" * 9 + '",é\\x\n', encoding="utf-8")
    lines = files.load(spark, str(tmp_path / "wide.csv")).first()["content"].split("\n")
    assert lines[:4] == [" | ".join(c) for c in cells] and lines[4].endswith(" | é\\x")
    (tmp_path / "none.csv").write_text("", encoding="utf-8")
    assert files.load(spark, str(tmp_path / "none.csv")).count() == 0


def test_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain", encoding="utf-8")
    (tmp_path / "b.csv").write_text('x,,"two\nlines"\n,,\n1,2\n', encoding="utf-8")
    (tmp_path / "c.xyz").write_text("?", encoding="utf-8")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["error"]) for r in files.load_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("plain", None), "b.csv": ("x |  | two\nlines\n1 | 2", None), "c.xyz": (None, "no loader"), "d.pdf": (None, "pypdf needs pypdf")}
    p = spark.createDataFrame([("a.pdf", b"x"), ("b.txt", b"%PDF-1"), ("c.txt", b"x"), ("https://x.org/a", None)], "path string, content binary")
    assert [tuple(r) for r in p.select(files.sees(F.col("path"), F.col("content")), files.paginates(F.col("path"), F.col("content"))).collect()] == [(True, True), (True, True), (False, False), (True, False)]
    assert files.choose([{"content": "x"}]) == "data" and files.choose("a.txt") == "txt" and files.choose("a.what") is None and files.choose("https://x.org/a", vision=True) == "llm_image"


def test_values_in_memory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("from a file", encoding="utf-8")
    first = lambda x, **k: files.read_data(spark, x, **k).first()
    assert first("just text")["content"] == "just text" and first(str(tmp_path / "a.txt"))["content"] == "from a file"
    assert first(io.BytesIO("é".encode()))["content"] == "é" and first({"content": "one"})["image"] is None
    assert first([{"content": "one"}], vision=True)["image"] == b""
    with pytest.raises(ValueError):
        files.read_data(spark, 5)


def counted(path, answer):
    def call(prompt):
        with open(path, "a", encoding="utf-8") as f:
            f.write("x")
        return answer(prompt) if callable(answer) else answer

    return call


def calls(path):
    return len(path.read_text(encoding="utf-8")) if path.exists() else 0


def test_null_prompts_stay_and_equal_ones_are_asked_once(spark, tmp_path):
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, prompt string")
    got = rows(model.asked(p, counted(str(tmp_path / "n"), "yes")).select("k", "raw", "error", "input_tokens", "output_tokens"), "k")
    assert got == [(1, "yes", None, 1, 1), (2, "yes", None, 1, 1), (3, None, "no_content", 0, 0)] and calls(tmp_path / "n") == 1
    bad = model.asked(p.where("k = 1"), counted(str(tmp_path / "b"), lambda _: 1 / 0)).first()
    assert bad["error"].startswith("ZeroDivisionError") and calls(tmp_path / "b") == 2


def test_classification_asks_each_model_once(spark, tmp_path):
    pages_ = spark.createDataFrame([(k, 1, f"text {k}") for k in range(4)], "doc_id int, page_no int, content string")
    a = counted(str(tmp_path / "a"), '{"name": "x", "confidence": 9}')
    b = counted(str(tmp_path / "b"), lambda p: '{"name": "x", "confidence": 8}' if p[-1] in "01" else '{"name": "y", "confidence": 8}')
    c = counted(str(tmp_path / "c"), '{"name": "z", "confidence": 9}')
    out = Documents(pages_).classify([[a, b], [c]])
    assert rows(out.select("doc_id", "name", "layer"), "doc_id") == [(0, "x", 0), (1, "x", 0), (2, "z", 1), (3, "z", 1)]
    assert [calls(tmp_path / x) for x in "abc"] == [4, 4, 2]
    told = model.matched_classes(Documents(pages_.where("doc_id = 0")).text(), model.KeywordBackend([("text 0", "X", 7)]), [("w", "other", None), ("x", "this", schema.contract("n INT"))], "doc_id")
    assert rows(told.select("matched", "class_ord", "confidence", "status")) == [("x", 1, 7, "ok")]


def test_groups_to_typed_tables(spark):
    pages_ = spark.createDataFrame([(1, 1, "No: 5"), (1, 2, "No: 6"), (1, 3, "x")], "doc_id int, page_no int, content string")
    d = Documents(pages_)
    starts = F.col("after.content").startswith("No:") | F.col("after.content").startswith("x")
    groups = d.split_lazy(~starts, F.when(F.col("now.content") == "x", "odd").otherwise("bill"), F.when(F.col("after.content") == "x", "odd").otherwise("bill"))
    assert rows(groups.select("group_no", "classification", "pages"), "group_no") == [(1, "bill", [1]), (2, "bill", [2]), (3, "odd", [3])]
    out = d.extract_groups(groups, {"bill": (schema.contract("number STRING"), model.RegexBackend({"number": r"No: (\d)"}))})
    assert rows(out["bill"].select("group_key", "number"), "group_key") == [("1#1", "5"), ("1#2", "6")]
    assert rows(out[None]) == [("1#3", "odd", "no_contract")]
    eager = d.split_eager(lambda p: '{"groupOfDocuments": [{"pages": [1, 2], "classification": "bill"}]}')
    assert rows(eager.select("group_no", "classification", "pages")) == [(1, "bill", [1, 2])]


def test_conflicts_chunks_and_markdown(spark, tmp_path):
    pages_ = spark.createDataFrame([(1, 1, "No: 5"), (1, 2, "No: 6"), (2, 1, "No: 7")], "doc_id int, page_no int, content string")
    d = Documents(pages_)
    read = model.RegexBackend({"number": r"No: (\d)"})
    judge = counted(str(tmp_path / "j"), lambda p: '{"number": {"value": "6", "confidence": 9}}' if "5 | 6" in p else "?")
    assert rows(d.resolve(read, schema.contract("number STRING"), judge), "doc_id") == [(1, "6"), (2, "7")] and calls(tmp_path / "j") == 1
    long = spark.createDataFrame([(1, "nothing here\n\nNo: 4\n\nNo: 9"), (2, "none")], "doc_id int, content string")
    assert rows(model.extracted_by_chunk(long, read, schema.contract("number STRING"), "doc_id", 4), "doc_id") == [(1, "4"), (2, None)]
    page = lambda p: "# Five" if "5" in p else 1 / 0
    got = rows(d.markdown(page).select("doc_id", "page_no", "markdown"), "doc_id", "page_no")
    assert got[0] == (1, 1, "# Five") and got[1][2].startswith("<!-- Error processing page 2: ZeroDivisionError")


def test_evaluation_in_one_call(spark):
    docs = spark.createDataFrame([(k, 1, t) for k, t in ((1, "total 10 for ann"), (2, "total 20"), (3, "total 30"))], "doc_id int, page_no int, content string")
    kind = "doc_id int, total string, tags array<string>, who struct<name:string>"
    labels = spark.createDataFrame([(1, "10", ["a", "b"], ("ann",)), (2, "20", [], ("bob",)), (3, "30", None, None)], kind)
    predicted = spark.createDataFrame([(1, "10.05", ["a", "b"], ("ann",)), (2, "99", [], ("bob",))], kind)
    config = spark.createDataFrame([("total", "NUMERIC", 0.8, 0.01)], "field string, kind string, threshold double, tolerance double")
    out = Documents(docs).evaluate(predicted, labels, ["total", "tags", "who"], config)
    assert rows(out["rows"].select("doc_id", "field", "present", "matched"), "doc_id", "field") == [(1, "tags", True, True), (1, "total", True, True), (1, "who", True, True), (2, "tags", True, True), (2, "total", True, False), (2, "who", True, True), (3, "total", False, False)]
    m = {r["field"]: (r["tp"], r["fp"], r["fn"]) for r in out["field_metrics"].collect()}
    assert m == {"total": (1, 1, 1), "tags": (2, 0, 0), "who": (2, 0, 0)}
    assert rows(out["documents"]) == [(3, 1 / 3)] and rows(out["schema"]) == [(3, 2 / 3)]
    assert '"documents":{"documents":3' in out["report"].first()["report"]
    custom = evaluate.compared(spark.createDataFrame([(1, "f", "a")], "doc_id int, field string, expected string"), spark.createDataFrame([(1, "f", "b")], "doc_id int, field string, predicted string"), spark.createDataFrame([("f", "CUSTOM", 0.8, 0.01)], config.schema), "doc_id", custom=F.length("expected") == F.length("predicted"))
    assert custom.first()["matched"]


def test_nested_values(spark):
    p = spark.createDataFrame([('{"b": 1, "a": [1, 2]}', '{"a": [1, 2.0], "b": true}'), ('{"a": null}', "{}"), ("[1]", "[1, 2]"), ("x", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in p.select(similarity.deep_equal("a", "b")).collect()] == [True, True, False, True, True]
    e = spark.createDataFrame([(' {"b": 1, "a": "x"}', '{"a":"x","b":1}'), ("[1, 2]", "[2, 1]"), ("{x", "{x ")], "a string, b string")
    assert [r[0] for r in e.select(similarity.exact(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    s = spark.createDataFrame([('["ann", "zzzz"]',), ('{"n": "ann", "m": {}}',), ("[]",), ('[{"a": 1}]',), ("Ann",), (None,)], "v string")
    got = [r[0] for r in s.select(similarity.support(F.col("v"), F.lit("Ann was here"))).collect()]
    assert got == [pytest.approx(0.45), pytest.approx(0.25), 0.0, 0.5, 0.0, None] or got[:5] == [pytest.approx(0.45), pytest.approx(0.25), 0.0, 0.5, 0.0]


def test_settings_and_small_parts(spark):
    assert model.Settings("m").heat == 0 and model.Settings("m", thinking=False).heat == 1
    with pytest.raises(ValueError):
        model.Settings("")
    r = spark.range(1).select(model.Settings("m", thinking=True).request(F.lit("hi"), F.lit(6)).alias("r")).first()["r"]
    assert (r["model"], r["temperature"], r["max_tokens"], r["thinking_tokens"]) == ("m", 1.0, 3000, 3000)
    assert tables.recognition_options(("eng", "deu"), 6, 1, {"a": "b"}) == "--psm 6 --oem 1 -l eng+deu -c a=b"
    with pytest.raises(ValueError):
        tables.recognition_options(page_mode=14)
    one = spark.createDataFrame([({"b": "2", "text": "t"}, [("n ", None), ("", "x")], [("a",), ("b",)])], "m map<string,string>, f array<struct<name:string,value:string>>, t array<struct<text:string>>")
    got = one.select(prompts.metadata(F.col("m")).alias("m"), prompts.entry(F.col("m"), "q", F.lit("none")).alias("e"), tables.form_pairs(F.col("f")).alias("f"), tables.fragments_text(F.col("t")).alias("t"), tables.sorted_entries(F.col("m")).alias("s"), prompts.dynamic_prompt(F.lit("p")).alias("p")).first()
    assert got["m"] == {"b": "2"} and got["e"] == "none" and [tuple(x) for x in got["f"]] == [("n", "")] and got["t"] == "a b" and got["s"][0]["key"] == "b" and got["p"].startswith("p\n\n")
    p = spark.createDataFrame([(1, 1), (1, 2)], "doc int, page_no int")
    assert rows(tables.with_page_images(p, p.where("page_no = 2").withColumn("image", F.lit("i")), "doc"), "page_no") == [(1, 1, None), (1, 2, "i")]


def test_command_line(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("No: 5", encoding="utf-8")
    (tmp_path / "labels.json").write_text('{"a.txt": {"number": "5"}}', encoding="utf-8")
    out = cli.run(spark, {"documents": str(tmp_path / "docs"), "labels": str(tmp_path / "labels.json"), "contract": "number STRING", "patterns": {"number": r"No: (\d)"}, "output": str(tmp_path / "out")})
    assert rows(out["documents"]) == [(1, 1.0)] and '"accuracy":1.0' in spark.read.text(str(tmp_path / "out")).first()[0]
    with pytest.raises(ValueError):
        cli.run(spark, {})


def test_answers_are_read_once_and_prompts_not_sorted_for_the_distinct_ones(spark):
    d = spark.createDataFrame([(1, 'a: "x"'), (2, "a: y"), (3, None)], "k int, content string")
    backend = model.RegexBackend({"a": r"a: (.+)$", "b": r"b: (.+)$"})
    got = model.extracted(d, backend, schema.contract("a STRING, b STRING, c STRING"), "k")
    assert rows(got, "k") == [(1, '"x"', None, None, True, None), (2, "y", None, None, True, None), (3, None, None, None, False, "no_content")]
    by_page = model.extracted_by_page(d.withColumn("page_no", F.lit(1)), backend, schema.contract("a STRING, b STRING"), "k")
    for out in (got, by_page):
        plan = out._jdf.queryExecution()
        assert "SortAggregate" not in plan.executedPlan().toString() and plan.optimizedPlan().toString().count("from_json(") == 1
