import random

from pyspark.sql import functions as F

from sheaf.functions import numbers as N
from sheaf.functions import similarity as S
from sheaf.functions import text as X


def one(spark, column, **values):
    names = list(values)
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()]).select(column(*map(F.col, names)).alias("x")).first()["x"]


def test_tokens_agree_with_python(spark):
    r = random.Random(1)
    texts = ["", " ", "abcde" * 9, "12345 a,b!!", "Hello 世界"] + ["".join(r.choice("aB1é ,.\n") for _ in range(r.randrange(60))) for _ in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.token_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [X.count_tokens(r["t"]) for r in rows]


def test_json_in_model_text(spark):
    assert one(spark, X.first_json, t='say {"a": 1} {') == '{"a": 1}'
    assert one(spark, X.first_json, t="say {a}") is None
    assert one(spark, X.thinking_json, t='<think>x</think>```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, X.thinking_json, t='```\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.thinking_json, t='it is {"a": {"b": 2}} so') == '{"a": {"b": 2}}'
    assert one(spark, X.thinking_json, t="nothing") is None
    assert one(spark, lambda a, b: X.joined_json(F.array(a, b)), a='```json{"a":', b=' 1}\n```') == '{"a":1}'
    assert one(spark, X.continues_json, t="[1") and not one(spark, X.continues_json, t="no")


def test_truncation_looks_for_the_stop_in_the_half_that_is_left():
    text = "One two three. Four five six. Seven eight nine."
    cut = X.cut_to_tokens(text, 7)
    assert cut.endswith("....") and text.startswith(cut[:-3])
    assert X.cut_to_tokens(text, 100) == text and X.cut_to_tokens("", 0) == ""
    assert X.cut_to_tokens("word " * 50, 5).endswith("...")


def test_truncation_against_recursion():
    import random

    def place(text, most, low, high):
        if low >= high:
            return low
        half = (low + high) // 2
        stops = [k for k in range(low, half) if text[k] == "."]
        end = (stops[-1] if stops else half) + 1
        return place(text, most, half + 1, high) if X.count_tokens(text[:end]) <= most else place(text, most, low, half)

    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab c. de, fghi") for _ in range(r.randrange(1, 120)))
        most = r.randrange(1, 20)
        at = place(text, most, 0, len(text))
        stops = [k for k in range(at) if text[k] == "."]
        want = text if X.count_tokens(text) <= most else text[: (stops[-1] if stops else at) + 1] + "..."
        assert X.cut_to_tokens(text, most) == want


def test_names_and_addresses(spark):
    assert one(spark, X.extension, p="/a/b.c/Report.PDF") == "pdf"
    assert one(spark, X.extension, p="/a/b.c/README") == ""
    assert one(spark, X.basename, p="/a/b/c.txt") == "c.txt"
    assert one(spark, X.is_url, p="https://x.org/a") and not one(spark, X.is_url, p="/x.org") and not one(spark, X.is_url, p="http:///a")
    assert one(spark, X.without_data_uri, p="data:image/png;base64,QUJD") == "QUJD"
    assert one(spark, lambda b: X.base64_text(b), b=bytearray(b"x" * 300)).count("\n") == 0


def test_html(spark):
    page = '<script>var t="</p>";</script><h1>Head</h1><!-- no --><p>One &amp; two</p>\n  <nav>menu</nav><p>three'
    assert one(spark, X.html_text, h=page) == "HeadOne & two three"
    assert one(spark, lambda h: X.html_text(h, "summarize"), h=page) == "One & two three"
    assert one(spark, X.html_headers, h=page) == ["Head"]
    assert one(spark, lambda h: X.parsed_html_text()(h), h=page) == "HeadOne & two three"


def test_yaml(spark):
    assert one(spark, X.yaml_block, t='{"a": [1, 2]}') == "a:\n- 1\n- 2\n"
    assert one(spark, X.yaml_to_json, t="a: [1, 2]") == '{"a": [1, 2]}'


def test_images_in_text(spark):
    filled = one(spark, lambda t: X.images_filled(t, F.array(F.struct(F.lit("i1").alias("id"), F.lit("a cat").alias("text")))), t="see ![i1](i1)")
    assert filled == "see [Image content: a cat]"
    assert one(spark, lambda t: X.with_placeholder_note(t, "look"), t="[Image processing failed: x]").endswith("look")


def test_budgets(spark):
    assert one(spark, N.thinking_tokens, p=1) == 1200 and one(spark, N.thinking_tokens, p=10) == 5000 and one(spark, N.thinking_tokens, p=1000) == 64000
    assert one(spark, N.thinking_tokens, p=0) is None
    assert [(t["top"], t["bottom"]) for t in one(spark, N.tiles, h=2500)] == [(0, 1000), (1000, 2000), (2000, 2500)]


def test_matches(spark):
    def m(kind, a, b, least=0.8, tolerance=0.01):
        rows = spark.createDataFrame([(kind, a, b, least, tolerance)], "k string, a string, b string, l double, t double")
        return rows.select(S.matches(*map(F.col, "kablt")).alias("x")).first()["x"]

    assert m("EXACT", " a ", "a\n") and not m("EXACT", "a", "b")
    assert m("NUMERIC", "100", "100.5") and not m("NUMERIC", "100", "102") and m("NUMERIC", "0", "0.005") and m("NUMERIC", "1_000", "1000")
    assert m("NUMERIC", "x", "x") and not m("NUMERIC", "1d", "1")
    assert m("FUZZY", "invoice", "invoices") and not m("FUZZY", "invoice", "receipt")
    assert m("NONE SUCH", "a", "a") and m("EXACT", None, None) and not m("EXACT", None, "a")


def test_indel_against_dynamic_programming():
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.indel(a, b) == (2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0)


def test_unsupported(spark):
    d = "The total is 1125 for services"
    for value, score in (("1125", 0.0), ("services total", 0.3), ("xxservxx", 0.6), ("qq", 0.9)):
        assert one(spark, S.unsupported, v=value, d=d) == score
