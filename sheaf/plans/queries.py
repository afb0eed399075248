"""The registered queries of the document operators, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf import schema
from sheaf.functions import numbers as N
from sheaf.functions import similarity as S
from sheaf.functions import text as X
from sheaf.operators import classify, evaluate, merge, model, pages, prompts, split, tables
from sheaf.plans.documents import Documents
from sheaf.sources import mime

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_BLANK = r"[\t-\r\x1C-\x20]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(lower({x}), '{X.TOKEN}'), lambda z: CASE WHEN length(z) <= 4 THEN 1 ELSE length(z) // 4 END)), 0)::BIGINT"


def _parts(x: str, by: str = "chr(10)") -> str:
    return f"list_filter(list_transform(string_split({x}, {by}), lambda z: {_strip('z')}), lambda z: z <> '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders with a place of their own: line numbers repeat."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
    return table(spark, d, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS pos FROM lineitem)"


def _conversation_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page_no"), "role", F.col("text").alias("content"))


_CONV = "(SELECT conv_id, turn + 1 AS page_no, role, text AS content FROM conversations)"

# --- pages


@query(f"SELECT doc_id, 1 AS page_no, {_strip('text')} AS content FROM documents")
def load_txt_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.txt_pages(table(spark, d, "documents"))


@query(f"SELECT doc_id, unnest(range(1, len(w) + 1))::INTEGER AS page_no, unnest(w) AS content FROM (SELECT doc_id, {_parts('text')} AS w FROM documents)")
def split_paragraph_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.txt_pages(table(spark, d, "documents"), separator="\n")


@query(f"SELECT doc_id, unnest(range(1, len(w) + 1))::INTEGER AS page_no, unnest(w) AS content FROM (SELECT doc_id, {_parts('text', 'chr(12)')} AS w FROM documents)")
def form_feed_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.txt_pages(table(spark, d, "documents"), separator="\f")


@query(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query(
    """SELECT conv_id, count(*) AS pages, least(count(*) * 1500, 120000)::BIGINT AS content_tokens,
    greatest(1200, least((count(*) * 500), 64000))::BIGINT AS thinking_tokens FROM conversations GROUP BY conv_id"""
)
def thinking_budget(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages"))
    return n.select("conv_id", "pages", N.content_tokens(F.col("pages")).alias("content_tokens"), N.thinking_tokens(F.col("pages")).alias("thinking_tokens"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN least(n_chars, 8000) WHEN doc_id % 3 = 1
    THEN greatest(1200, least(greatest(1, n_chars // 3000) * 500, 64000)) ELSE 8000 END::BIGINT AS max_tokens FROM documents"""
)
def max_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    limit = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))
    page_count = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_chars") / 3000))
    return t.select("doc_id", N.answer_tokens(limit, N.thinking_tokens(page_count), F.col("doc_id") % 3 == 1).alias("max_tokens"))


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id, {_parts('text')} AS w FROM documents),
t AS (SELECT doc_id, w, list_transform(w, lambda x: {_tokens('x')}) AS k FROM p WHERE len(w) > 0),
f(doc_id, i, n, now) AS (SELECT doc_id, 1, 1, k[1] FROM t
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN now + k[i + 1] + 1 <= 200 THEN n ELSE n + 1 END, CASE WHEN now + k[i + 1] + 1 <= 200 THEN now + k[i + 1] ELSE k[i + 1] END
  FROM f JOIN t USING (doc_id) WHERE i < len(k))
SELECT f.doc_id, n::INTEGER AS chunk_no, sum(k[i])::BIGINT AS tokens, string_agg(w[i], chr(10) || chr(10) ORDER BY i) AS content FROM f JOIN t USING (doc_id) GROUP BY 1, 2"""
)
def chunk_greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    return pages.chunks(table(spark, d, "documents"), 200, separator="\n")


@query(f"SELECT conv_id, string_agg(content, chr(10) || chr(10) ORDER BY page_no) FILTER (content <> '') AS content, count(*) AS num_pages FROM {_CONV} GROUP BY conv_id")
def doc_text_join(spark: SparkSession, d: str) -> DataFrame:
    return pages.joined(_conversation_pages(spark, d), "conv_id")


@query(
    f"""WITH j AS (SELECT conv_id, string_agg(content, chr(10) || chr(10) ORDER BY page_no) AS content, count(*) AS num_pages FROM {_CONV} GROUP BY conv_id)
SELECT conv_id // 4 AS batch, string_agg(content, chr(10) || chr(10) || '--- Document Separator ---' || chr(10) || chr(10) ORDER BY conv_id) AS content,
count(*) AS num_documents, sum(num_pages)::BIGINT AS num_pages FROM j GROUP BY 1"""
)
def multi_doc_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = pages.joined(_conversation_pages(spark, d), "conv_id").withColumn("batch", F.floor(F.col("conv_id") / 4))
    return pages.merged_documents(docs, "batch", "conv_id")


@query(f"SELECT r.pos::INTEGER AS pos, c.conv_id, c.page_no, c.role, c.content FROM {_CONV} c JOIN (VALUES (1, 3), (2, 1), (3, 1)) r(pos, n) ON c.page_no = r.n")
def page_select(spark: SparkSession, d: str) -> DataFrame:
    return pages.selected(_conversation_pages(spark, d), [3, 1, 1])


@query("SELECT conv_id, count(*) AS pages, CASE WHEN count(*) < 3 THEN 'too_few_pages' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id")
def min_pages_guard(spark: SparkSession, d: str) -> DataFrame:
    return pages.with_page_guard(_conversation_pages(spark, d), "conv_id", 3)


@query(
    f"""SELECT conv_id, page_no, content, next_page_no, next_content FROM (SELECT conv_id, page_no, content, lead(page_no) OVER w AS next_page_no,
lead(content) OVER w AS next_content, count(*) OVER (PARTITION BY conv_id) AS n FROM {_CONV} WINDOW w AS (PARTITION BY conv_id ORDER BY page_no)) WHERE next_page_no IS NOT NULL OR n = 1"""
)
def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_pairs(_conversation_pages(spark, d), "conv_id")


@query(f"SELECT conv_id, page_no, CASE WHEN contains(content, role) THEN content ELSE content || chr(10) || 'Sheet: ' || role END AS content FROM {_CONV}")
def sheet_name_append(spark: SparkSession, d: str) -> DataFrame:
    return pages.with_sheet_names(_conversation_pages(spark, d), sheet="role").select("conv_id", "page_no", "content")


# --- splitting

_CLASS_SQL = "CASE WHEN role = 'system' THEN 'instruction' WHEN contains({t}, ',') THEN 'prose' ELSE 'note' END"
_GROUPS = f"""WITH v AS (SELECT conv_id, page_no, role, content, {_CLASS_SQL.format(t='content')} AS c, lead(role) OVER w AS r2 FROM {_CONV} WINDOW w AS (PARTITION BY conv_id ORDER BY page_no)),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY page_no) AS group_no
FROM (SELECT *, lag(page_no) OVER (PARTITION BY conv_id ORDER BY page_no) AS before FROM v)),
g AS (SELECT conv_id, group_no::BIGINT AS group_no, arg_min(c, page_no) AS classification, list(page_no::INTEGER ORDER BY page_no) AS pages FROM b GROUP BY 1, 2)"""


def _page_class(row: str) -> Column:
    return F.when(F.col(f"{row}.role") == "system", "instruction").when(F.contains(F.col(f"{row}.content"), F.lit(",")), "prose").otherwise("note")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    v = split.verdicts(_conversation_pages(spark, d), F.col("after.role") != "user", _page_class("now"), _page_class("after"), "conv_id")
    return split.lazy_groups(v, "conv_id")


@query(_GROUPS + " SELECT * FROM g")
def lazy_split_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


@query(_GROUPS + " SELECT g.conv_id, g.group_no, g.classification, (list_position(g.pages, c.page_no::INTEGER) - 1)::INTEGER AS pos, c.page_no, c.role, c.content FROM g JOIN " + _CONV + " c ON c.conv_id = g.conv_id AND list_contains(g.pages, c.page_no::INTEGER)")
def group_page_slice(spark: SparkSession, d: str) -> DataFrame:
    return split.group_pages(_groups(spark, d), _conversation_pages(spark, d), "conv_id")


@query(
    _GROUPS
    + f""", p AS (SELECT conv_id, group_no, classification, unnest(pages) AS page_no FROM g),
j AS (SELECT p.conv_id, group_no, classification, string_agg(content, chr(10) || chr(10) ORDER BY p.page_no) AS content, count(*) AS num_pages FROM p JOIN {_CONV} c ON c.conv_id = p.conv_id AND c.page_no = p.page_no GROUP BY 1, 2, 3)
SELECT conv_id, group_no, classification, content, num_pages, {_tokens('content')} AS tokens FROM j"""
)
def split_documents(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as page streams: split, joined and counted. The groups and their text come from one sort of the pages."""
    p = _conversation_pages(spark, d)
    v = split.verdicts(p, F.col("after.role") != "user", _page_class("now"), _page_class("after"), "conv_id")
    groups = split.lazy_groups(v, "conv_id")
    rows = groups.join(p.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").cast("int").alias("n"), "content"))).alias("text")), "conv_id")
    own = F.filter("text", lambda x: F.array_contains("pages", x["n"]) & (x["content"] != ""))
    content = F.array_join(F.transform(own, lambda x: x["content"]), "\n\n")
    out = rows.select("conv_id", "group_no", "classification", content.alias("content"), F.size("pages").cast("long").alias("num_pages"))
    return out.withColumn("tokens", X.token_count(F.col("content")))


@query(
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
e AS (SELECT conv_id, 1 AS group_no, 'head' AS classification, [1] AS pages FROM n WHERE conv_id % 2 = 0 UNION ALL
SELECT conv_id, 2, 'rest', [x::INTEGER FOR x IN range(2, n + 1)] FROM n WHERE conv_id % 2 = 0 UNION ALL
SELECT conv_id, 1, 'unknown', [x::INTEGER FOR x IN range(1, n + 1)] FROM n WHERE conv_id % 2 = 1) SELECT * FROM e"""
)
def eager_group_explode(spark: SparkSession, d: str) -> DataFrame:
    n = _conversation_pages(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_pages"))
    whole = F.to_json(F.struct(F.array(F.struct(F.array(F.lit(1)).alias("pages"), F.lit("head").alias("classification")), F.struct(F.when(F.col("num_pages") > 1, F.sequence(F.lit(2), F.col("num_pages").cast("int"))).otherwise(F.array().cast("array<int>")).alias("pages"), F.lit("rest").alias("classification"))).alias("groupOfDocuments")))
    raw = F.when(F.col("conv_id") % 2 == 0, whole).otherwise("not JSON")
    return split.eager_groups(n.withColumn("raw", raw), "conv_id")


# --- classification

_CLASSES = ["invoice", "credit note", "driver license", "bank statement"]
_NAMES = "['invoice','credit note','driver license','bank statement']"
_VOTES = f"""WITH v AS (SELECT doc_id, layer, model_ord, {_NAMES}[1 + ((doc_id // (1 + layer) + model_ord * (doc_id % 3)) % 4)] AS name,
1 + ((doc_id * 7 + layer * 3 + model_ord * 5) % 10) AS confidence FROM documents, range(0, 2) a(layer), range(0, 3) b(model_ord)),
s AS (SELECT doc_id, layer, min(name) = max(name) AS same, min(confidence) AS least, arg_min(name, model_ord) AS name, arg_min(confidence, model_ord) AS confidence,
arg_max(name, confidence * 10 - model_ord) AS top, max(confidence) AS top_confidence FROM v GROUP BY 1, 2)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """Three models in two layers, their answers made from document numbers."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("layer"))
    t = t.withColumn("model_ord", F.explode(F.sequence(F.lit(0), F.lit(2))))
    at = (F.floor(F.col("doc_id") / (1 + F.col("layer"))) + F.col("model_ord") * (F.col("doc_id") % 3)) % 4
    return t.select("doc_id", "layer", "model_ord", F.element_at(F.array(*map(F.lit, _CLASSES)), (at + 1).cast("int")).alias("name"), (1 + (F.col("doc_id") * 7 + F.col("layer") * 3 + F.col("model_ord") * 5) % 10).alias("confidence"))


@query(_VOTES + " SELECT doc_id, layer::INTEGER AS layer, name, confidence FROM s WHERE same")
def vote_consensus(spark: SparkSession, d: str) -> DataFrame:
    return classify.vote(_votes(spark, d), ["doc_id", "layer"], classify.CONSENSUS)


@query(_VOTES + " SELECT doc_id, layer::INTEGER AS layer, top AS name, top_confidence AS confidence FROM s")
def vote_higher_order(spark: SparkSession, d: str) -> DataFrame:
    return classify.vote(_votes(spark, d), ["doc_id", "layer"], classify.HIGHER_ORDER)


@query(_VOTES + " SELECT doc_id, layer::INTEGER AS layer, name, confidence FROM s WHERE same AND least >= 3")
def vote_consensus_threshold(spark: SparkSession, d: str) -> DataFrame:
    return classify.vote(_votes(spark, d), ["doc_id", "layer"], classify.CONSENSUS_WITH_THRESHOLD, 3)


@query(
    _VOTES
    + """, f AS (SELECT doc_id, min(layer) AS layer FROM s WHERE same GROUP BY 1)
SELECT doc_id, layer::INTEGER AS layer, name, confidence, CASE WHEN layer IS NULL THEN 'unresolved' ELSE 'ok' END AS status
FROM (SELECT DISTINCT doc_id FROM v) LEFT JOIN f USING (doc_id) LEFT JOIN s USING (doc_id, layer)"""
)
def layer_cascade(spark: SparkSession, d: str) -> DataFrame:
    return classify.cascade(_votes(spark, d), "doc_id", classify.CONSENSUS)


_RULE = "CASE WHEN contains(lower(text), ' the ') THEN ' English' WHEN regexp_matches(lower(text), ' (und|der) ') THEN 'GERMAN ' WHEN contains(lower(text), '@') THEN 'mail' ELSE 'nothing' END"


@query(
    f"""WITH c AS (SELECT * FROM (VALUES (0, 'english'), (1, 'German'), (2, 'english'), (3, 'other')) t(ord, class_name)),
m AS (SELECT lower({_strip('class_name')}) AS k, arg_min(class_name, ord) AS matched, min(ord)::INTEGER AS class_ord FROM c GROUP BY 1)
SELECT doc_id, name, matched, class_ord, CASE WHEN matched IS NULL THEN 'unmatched' ELSE 'ok' END AS status FROM (SELECT doc_id, {_RULE} AS name FROM documents) d LEFT JOIN m ON m.k = lower({_strip('name')})"""
)
def classify_rule_match(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([(0, "english"), (1, "German"), (2, "english"), (3, "other")], "ord int, class_name string")
    t = F.lower("text")
    name, _ = classify.by_rules(t, [(" the ", " English", 9), (" (und|der) ", "GERMAN ", 9), ("@", "mail", 5)], "nothing")
    return classify.matched(table(spark, d, "documents").select("doc_id", name.alias("name")), classes)


@query(
    f"""WITH s AS (SELECT doc_id, c AS class_ord, {_NAMES}[1 + c] AS name, (doc_id * 3 + c * 5) % 11 - 4 AS confidence FROM documents, range(0, 4) t(c)),
b AS (SELECT doc_id, arg_max(name, confidence * 10 - class_ord) AS name, max(confidence) AS confidence FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN confidence > 0 THEN name ELSE 'Unknown' END AS name, CASE WHEN confidence > 0 THEN confidence ELSE 1 END AS confidence FROM b"""
)
def best_image_class(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("class_ord"))
    t = t.select("doc_id", "class_ord", F.element_at(F.array(*map(F.lit, _CLASSES)), F.col("class_ord") + 1).alias("name"), ((F.col("doc_id") * 3 + F.col("class_ord") * 5) % 11 - 4).alias("confidence"))
    return classify.best_class(t, "doc_id")


_TREE = [("fin", None), ("id", None), ("inv", "fin"), ("cn", "fin"), ("dl", "id"), ("sales", "inv")]
_TREE_SQL = """WITH t AS (SELECT * FROM (VALUES ('fin', NULL), ('id', NULL), ('inv', 'fin'), ('cn', 'fin'), ('dl', 'id'), ('sales', 'inv')) x(uuid, parent)),
a AS (SELECT doc_id, ['fin','id','other'][1 + (doc_id % 3)] AS u1, ['inv','cn','dl'][1 + (doc_id // 3) % 3] AS u2, 'sales' AS u3,
1 + (doc_id * 7) % 10 AS c1, 1 + (doc_id * 3) % 10 AS c2, 1 + doc_id % 10 AS c3 FROM documents),
s1 AS (SELECT *, CASE WHEN c1 < 3 THEN 'low_confidence' WHEN u1 IN ('fin', 'id') THEN 'ok' ELSE 'unmatched' END AS st1 FROM a),
s2 AS (SELECT *, CASE WHEN st1 <> 'ok' THEN st1 WHEN c2 < 3 THEN 'low_confidence' WHEN (u1 = 'fin' AND u2 IN ('inv', 'cn')) OR (u1 = 'id' AND u2 = 'dl') THEN 'ok' ELSE 'unmatched' END AS st2 FROM s1),
s3 AS (SELECT *, CASE WHEN st2 <> 'ok' OR u2 <> 'inv' THEN st2 WHEN c3 < 3 THEN 'low_confidence' ELSE 'ok' END AS st3 FROM s2)
SELECT doc_id, CASE WHEN st1 <> 'ok' THEN NULL WHEN st2 <> 'ok' THEN u1 WHEN u2 = 'inv' AND st3 = 'ok' THEN 'sales' ELSE u2 END AS uuid,
CASE WHEN st1 <> 'ok' THEN 0 WHEN st2 <> 'ok' THEN 1 WHEN u2 = 'inv' AND st3 = 'ok' THEN 3 ELSE 2 END AS level, st3 AS status FROM s3"""


@query(_TREE_SQL)
def tree_classify(spark: SparkSession, d: str) -> DataFrame:
    tree = spark.createDataFrame(_TREE, "uuid string, parent_uuid string")
    i = F.col("doc_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    said = F.array(
        F.struct(F.lit(1).alias("level"), pick(["fin", "id", "other"], i % 3).alias("uuid"), (1 + i * 7 % 10).alias("confidence")),
        F.struct(F.lit(2).alias("level"), pick(["inv", "cn", "dl"], F.floor(i / 3) % 3).alias("uuid"), (1 + i * 3 % 10).alias("confidence")),
        F.struct(F.lit(3).alias("level"), F.lit("sales").alias("uuid"), (1 + i % 10).alias("confidence")),
    )
    answers = table(spark, d, "documents").select("doc_id", F.explode(said).alias("a")).select("doc_id", "a.*")
    return classify.through_tree(answers, tree, "doc_id", 3, 3)


@query("SELECT doc_id, list_contains([contains(lower(source), x) FOR x IN ['web', 'o1']], true) AS batch FROM documents")
def batch_model_predicate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", classify.supports_batches(F.col("source"), ("web", "o1")).alias("batch"))


# --- merging page results; a line of an order is a page that tells something about it

_FLAGS = f"(SELECT l_orderkey, list(l_returnflag ORDER BY pos) AS a, list(l_linestatus ORDER BY pos) AS b FROM {_LINES} GROUP BY 1)"


def _distinct(x: str) -> str:
    """First appearances, in order."""
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda p: list_position({x}, p[1]) = p[2]), lambda p: p[1])"


@query(
    f"""WITH g AS (SELECT l_orderkey, {_distinct('a')} AS a, {_distinct('b')} AS b FROM {_FLAGS})
SELECT l_orderkey, CASE WHEN len(a) = 1 THEN a[1] END AS flag, array_to_string(a, ',') AS flag_candidates, len(a) > 1 AS flag_conflict,
CASE WHEN len(b) = 1 THEN b[1] END AS status, array_to_string(b, ',') AS status_candidates, len(b) > 1 AS status_conflict FROM g"""
)
def merge_scalar_conflict(spark: SparkSession, d: str) -> DataFrame:
    m = merge.scalars(_lines(spark, d), ["l_orderkey"], ["l_returnflag", "l_linestatus"], "pos")
    part = lambda f, n: [F.col(f"{f}.value").alias(n), F.array_join(f"{f}.candidates", ",").alias(f"{n}_candidates"), F.col(f"{f}.is_conflict").alias(f"{n}_conflict")]
    return m.select("l_orderkey", *part("l_returnflag", "flag"), *part("l_linestatus", "status"))


@query(f"SELECT l_orderkey, a[1] AS l_returnflag, b[1] AS l_linestatus FROM {_FLAGS}")
def conflict_cleanup(spark: SparkSession, d: str) -> DataFrame:
    fields = ["l_returnflag", "l_linestatus"]
    return merge.settled(merge.scalars(_lines(spark, d), ["l_orderkey"], fields, "pos"), ["l_orderkey"], fields)


@query(
    f"""WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(pos) AS o FROM {_LINES} GROUP BY 1, 2)
SELECT l_orderkey, arg_max(l_returnflag, n * 1000 - o) AS l_returnflag FROM n GROUP BY 1"""
)
def resolve_conflict_rule(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d)
    m = merge.scalars(t, ["l_orderkey"], ["l_returnflag"], "pos")
    return merge.resolved(m, merge.by_majority(t, ["l_orderkey"], "l_returnflag", "pos"), ["l_orderkey"], ["l_returnflag"])


@query(
    f"""WITH i AS (SELECT l_orderkey, pos AS o, lower(l_returnflag) AS k, l_returnflag AS name, CASE WHEN l_discount > 0.05 THEN l_quantity END AS quantity, l_linestatus AS s FROM {_LINES}),
g AS (SELECT l_orderkey, k, min(o) AS o, arg_min(name, o) AS name, arg_min(quantity, o) FILTER (quantity IS NOT NULL) AS quantity, string_agg(s, ',' ORDER BY o, s) AS statuses FROM i GROUP BY 1, 2)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY o))::INTEGER AS place, name, quantity, statuses FROM g"""
)
def merge_list_by_key(spark: SparkSession, d: str) -> DataFrame:
    quantity = F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))
    t = _lines(spark, d).select("l_orderkey", "pos", F.array(F.struct(F.col("l_returnflag").alias("name"), quantity.alias("quantity"), F.array("l_linestatus").alias("statuses"))).alias("items"))
    out = merge.items(t, ["l_orderkey"], "items", "pos", ["name", "quantity", "statuses"], lists=("statuses",))
    return out.withColumn("statuses", F.array_join("statuses", ","))


@query(
    f"""SELECT l_orderkey, arg_min(l_quantity, pos) FILTER (l_discount > 0.05) AS quantity, arg_min(l_returnflag, pos) AS flag,
string_agg(l_partkey::VARCHAR, ',' ORDER BY pos) AS parts FROM {_LINES} GROUP BY 1"""
)
def aggregate_first_wins(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).select("l_orderkey", "pos", F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("quantity"), F.col("l_returnflag").alias("flag"), F.array(F.col("l_partkey").cast("string")).alias("parts"))
    return merge.first_wins(t, ["l_orderkey"], "pos", ["quantity", "flag"], ("parts",)).withColumn("parts", F.array_join("parts", ","))


# --- evaluation


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def docs_missing_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.unlabelled(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)")
def labels_missing_docs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.orphaned(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents"), "doc_id")


@query("SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def docs_labels_join(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.dataset(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query(f"SELECT c_custkey, {_strip('c_mktsegment')} = {_strip('upper(c_mktsegment)')} AS same, c_name = ' ' || c_name AS untouched FROM customer")
def field_match_exact(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.exact(F.col("c_mktsegment"), F.concat(F.lit(" "), F.upper("c_mktsegment"))).alias("same"), (F.col("c_name") == F.concat(F.lit(" "), F.col("c_name"))).alias("untouched"))


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN abs(p) <= 0.01 ELSE abs(o_totalprice - p) / abs(o_totalprice) <= 0.01 END AS matched
FROM (SELECT o_orderkey, o_totalprice, o_totalprice * (1 + (o_orderkey % 5 - 2) * 0.007) AS p FROM orders)"""
)
def field_match_numeric(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    p = F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5 - 2) * F.lit(0.007))
    return o.select("o_orderkey", S.numeric(F.col("o_totalprice"), p, F.lit(0.01)).alias("matched"))


@query()
def field_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(S.indel_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"), S.fuzzy(F.col("p_name"), F.upper("p_name"), F.lit(0.8)).alias("matched"))


@query(
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def field_match_semantic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


_PRED = """(SELECT l.doc_id, f.field, CASE f.field WHEN 'quality' THEN l.quality WHEN 'toxic' THEN l.toxic ELSE l.doc_id % 2 END::VARCHAR AS expected,
CASE WHEN (l.doc_id + f.n) % 7 = 0 THEN NULL ELSE (CASE f.field WHEN 'quality' THEN CASE WHEN d.n_chars > {cut} THEN 1 ELSE 0 END WHEN 'toxic' THEN 0 ELSE l.doc_id % 3 END)::VARCHAR END AS predicted,
(l.doc_id + f.n) % 7 <> 0 AS present FROM labels l JOIN documents d USING (doc_id), (VALUES ('quality', 0), ('toxic', 1), ('parity', 2)) f(field, n))"""
_LONG = "SELECT *, present AND expected = predicted AS matched FROM " + _PRED.format(cut=400)


def _expected(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id").withColumn("parity", F.col("doc_id") % 2)
    return evaluate.long_form(wide, "doc_id", ["quality", "toxic", "parity"], "expected")


def _predicted(spark: SparkSession, d: str, cut: int = 400) -> DataFrame:
    wide = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > cut, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"), (F.col("doc_id") % 3).alias("parity"))
    n = F.element_at(F.create_map(*[F.lit(x) for p in (("quality", 0), ("toxic", 1), ("parity", 2)) for x in p]), F.col("field"))
    return evaluate.long_form(wide, "doc_id", ["quality", "toxic", "parity"], "predicted").where((F.col("doc_id") + n) % 7 != 0)


def _compared(spark: SparkSession, d: str, cut: int = 400) -> DataFrame:
    config = spark.createDataFrame([("toxic", "NUMERIC", 0.8, 0.01)], "field string, kind string, threshold double, tolerance double")
    return evaluate.compared(_expected(spark, d), _predicted(spark, d, cut), config, "doc_id")


@query(_LONG)
def compare_fields(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


_METRICS = """SELECT field, count(*) AS total, count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched AND present) AS fp, count(*) FILTER (NOT present) AS fn FROM ({long}) GROUP BY 1"""
_SCORES = (
    "SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1, round(tp / total, 9) AS accuracy FROM "
    "(SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM ({m}))"
)


@query(f"SELECT field, total, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, f1, accuracy FROM ({_SCORES.format(m=_METRICS.format(long=_LONG))})")
def field_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.field_metrics(_compared(spark, d))
    return m.select("field", "total", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    f"SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, round(avg(accuracy), 9) AS accuracy FROM "
    f"(SELECT precision, recall, f1, accuracy FROM ({_SCORES.format(m=_METRICS.format(long=_LONG))}) UNION ALL SELECT 0, 0, 0, 0)"
)
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    fields = spark.createDataFrame([("quality",), ("toxic",), ("parity",), ("never_seen",)], "field string")
    m = evaluate.macro_metrics(evaluate.field_metrics(_compared(spark, d), fields))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query(f"SELECT count(*) AS documents, round(avg(coalesce(w, true)::INTEGER), 9) AS accuracy FROM documents LEFT JOIN (SELECT doc_id, bool_and(matched) AS w FROM ({_LONG}) GROUP BY 1) USING (doc_id)")
def document_accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = evaluate.document_accuracy(_compared(spark, d), table(spark, d, "documents"), "doc_id")
    return a.withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT count(*) AS documents, round(avg((lang IN ('en', 'de') AND source IS NOT NULL)::INTEGER), 9) AS schema_success_rate FROM documents")
def schema_rate(spark: SparkSession, d: str) -> DataFrame:
    t = schema.checked(table(spark, d, "documents").select("lang", "source"), ["source"], {"lang": ["en", "de"]})
    return evaluate.schema_rate(t, "schema_valid").withColumn("schema_success_rate", F.round("schema_success_rate", 9))


@query("SELECT round(avg(value), 6) AS mean_s, min(value) AS min_s, max(value) AS max_s FROM events WHERE event_type <> 'error'")
def exec_time(spark: SparkSession, d: str) -> DataFrame:
    t = evaluate.times(table(spark, d, "events").withColumn("failed", F.col("event_type") == "error"), "value", "failed")
    return t.withColumn("mean_s", F.round("mean_s", 6))


@query(
    f"""WITH t AS (SELECT {_tokens('text')} AS i, ({_tokens('text')} // 4)::BIGINT AS o, lang FROM documents),
c AS (SELECT i, o, CASE lang WHEN 'en' THEN i * 0.001 + o * 0.002 WHEN 'de' THEN i * 0.002 + o * 0.004 ELSE 0 END::DOUBLE AS cost FROM t)
SELECT count(*) AS documents, round(sum(cost), 4) AS total_cost, round(avg(cost), 6) AS average_cost, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens FROM c"""
)
def cost_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("lang").alias("model"), X.token_count(F.col("text")).alias("input_tokens"))
    t = t.withColumn("output_tokens", F.floor(F.col("input_tokens") / 4))
    prices = spark.createDataFrame([("en", 0.001, 0.002), ("de", 0.002, 0.004)], "model string, input_price double, output_price double")
    c = evaluate.costs(evaluate.priced(t, prices))
    return c.withColumn("total_cost", F.round("total_cost", 4)).withColumn("average_cost", F.round("average_cost", 6))


_ACC = "(SELECT field, avg(matched::INTEGER) AS a FROM (SELECT *, present AND expected = predicted AS matched FROM {p}) GROUP BY 1)"


@query(
    f"""SELECT s.field, round(s.a, 9) AS student_accuracy, round(t.a, 9) AS teacher_accuracy, round(CASE WHEN s.a <> 0 THEN (t.a - s.a) / s.a * 100 WHEN t.a > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS improvement
FROM {_ACC.format(p=_PRED.format(cut=2000))} s JOIN {_ACC.format(p=_PRED.format(cut=400))} t USING (field)"""
)
def teacher_student_improvement(spark: SparkSession, d: str) -> DataFrame:
    t = evaluate.teacher_student(evaluate.field_metrics(_compared(spark, d)), evaluate.field_metrics(_compared(spark, d, 2000)))
    return t.select("field", F.round("student_accuracy", 9).alias("student_accuracy"), F.round("teacher_accuracy", 9).alias("teacher_accuracy"), F.round("improvement", 6).alias("improvement"))


_VALUES = f"""(SELECT doc_id, text, 'first' AS field, string_split(text, ' ')[1] AS value FROM documents UNION ALL
SELECT doc_id, text, 'swapped', string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[2] FROM documents UNION ALL
SELECT doc_id, text, 'made_up', 'zq' || string_split(text, ' ')[2] || 'xx' FROM documents UNION ALL
SELECT doc_id, text, 'strange', '0q9z8' FROM documents)"""
_SCORE_SQL = f"""SELECT doc_id, field, value, CASE WHEN contains(lower(text), v) THEN 0.0
WHEN len(regexp_extract_all(v, '{S.WORD}')) > 0 AND len(list_filter(regexp_extract_all(v, '{S.WORD}'), lambda w: NOT contains(lower(text), w))) = 0 THEN 0.3
WHEN length(v) > 3 AND len(list_filter(range(1, length(v) - 2), lambda i: contains(lower(text), substring(v, i, 4)))) > 0 THEN 0.6 ELSE 0.9 END::DOUBLE AS score
FROM (SELECT *, lower({_strip('value')}) AS v FROM {_VALUES} WHERE value IS NOT NULL)"""


def _hallucinations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text")
    w = lambda i: F.get(F.split("text", " "), F.lit(i))
    wide = t.select("doc_id", w(0).alias("first"), F.concat(w(2), F.lit(" "), w(1)).alias("swapped"), F.concat(F.lit("zq"), w(1), F.lit("xx")).alias("made_up"), F.lit("0q9z8").alias("strange"))
    return evaluate.hallucinations(evaluate.long_form(wide, "doc_id", ["first", "swapped", "made_up", "strange"], "value"), t, "doc_id")


@query(_SCORE_SQL)
def hallucination_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return _hallucinations(spark, d)


@query(f"SELECT doc_id, count(*) AS fields, avg(CASE WHEN score >= 0.7 THEN 1.0 ELSE 0.0 END)::DOUBLE AS overall FROM ({_SCORE_SQL}) GROUP BY 1")
def hallucination_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hallucination_rate(_hallucinations(spark, d), "doc_id")


@query()
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _compared(spark, d)
    return evaluate.report("labels", metrics=evaluate.macro_metrics(evaluate.field_metrics(rows)), documents=evaluate.document_accuracy(rows, table(spark, d, "labels"), "doc_id"))


@query(
    f"""SELECT field, printf('%s: precision %.2f%%, recall %.2f%%, f1 %.2f%%', field, precision * 100, recall * 100, f1 * 100) AS line FROM ({_SCORES.format(m=_METRICS.format(long=_LONG))})"""
)
def printed_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.printed(evaluate.field_metrics(_compared(spark, d)))


# --- what models write, and what they are sent


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN props END AS first_json FROM events")
def extract_json_first(spark: SparkSession, d: str) -> DataFrame:
    """Texts without JSON, with a nested object, which the first closing brace breaks, and with two objects."""
    i = F.col("event_id") % 4
    said = F.when(i == 0, F.lit("no JSON } here")).when(i == 1, F.lit('so {"a": {"b": 1}} it is')).otherwise(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" and {more}")))
    return table(spark, d, "events").select("event_id", X.first_json(said).alias("first_json"))


@query("""SELECT event_id, CASE WHEN event_id % 6 < 3 THEN (props->>'k')::BIGINT WHEN event_id % 6 = 3 THEN 7 END AS k, event_id % 6 < 4 AS valid FROM events""")
def extract_thinking_json(spark: SparkSession, d: str) -> DataFrame:
    """Fenced with a language, fenced, bare, nested, broken off, and without any JSON."""
    i = F.col("event_id") % 6
    p = F.col("props")
    said = F.when(i == 0, F.concat(F.lit("<think>hm</think>\n```json\n"), p, F.lit("\n```"))).when(i == 1, F.concat(F.lit("so ```\n"), p, F.lit("```"))).when(i == 2, F.concat(F.lit("It is "), p))
    said = said.when(i == 3, F.lit('well {"k": 7, "more": {"k": 1}} then')).when(i == 4, F.lit('{"k": 5, "cut')).otherwise(F.lit("I don't know"))
    r = schema.read(X.thinking_json(said), schema.contract("k BIGINT"))
    return table(spark, d, "events").select("event_id", r.alias("r")).select("event_id", "r.parsed.k", "r.valid")


@query("""SELECT event_id, props AS whole, (props->>'k')::BIGINT AS k FROM events""")
def concat_json_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    half = F.array(F.concat(F.lit("```json"), F.substr(p, F.lit(1), F.lit(3))), F.lit("``` "), F.concat(F.substr(p, F.lit(4)), F.lit("```")))
    t = table(spark, d, "events").select("event_id", X.joined_json(half).alias("whole"))
    return t.select("event_id", "whole", F.get_json_object("whole", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE contains(props, '{') OR contains(props, '[') END AS continues FROM events")
def json_continuation(spark: SparkSession, d: str) -> DataFrame:
    """Null, empty and plain texts, an open list, and objects."""
    i = F.col("event_id") % 5
    said = F.when(i == 1, "").when(i == 2, "plain, no").when(i == 3, "a [1, 2").when(i == 4, F.col("props"))
    return table(spark, d, "events").select("event_id", X.continues_json(said).alias("continues"))


@query(
    """SELECT conv_id || '-' || turn AS custom_id, 'POST' AS method, 'm' AS model, 8000 AS max_tokens, 'system' AS first_role, '##Content' || chr(10) || chr(10) || text AS content FROM conversations"""
)
def batch_jsonl(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), prompts.messages("Extract.", F.col("text")).alias("messages"))
    j = prompts.batch_lines(t, "id", "m")
    at = lambda p: F.get_json_object("line", p)
    return j.select("custom_id", at("$.method").alias("method"), at("$.body.model").alias("model"), at("$.body.max_tokens").cast("int").alias("max_tokens"), at("$.body.messages[0].role").alias("first_role"), at("$.body.messages[1].content").alias("content"))


_STATES = "['validating','in_progress','finalizing','completed','failed','expired','cancelling','cancelled',' Completed ','?']"


@query(f"""SELECT event_id, CASE lower(trim(s)) WHEN 'validating' THEN 'queued' WHEN 'in_progress' THEN 'processing' WHEN 'finalizing' THEN 'processing' WHEN 'completed' THEN 'completed' ELSE 'failed' END AS status
FROM (SELECT event_id, {_STATES}[1 + event_id % 10] AS s FROM events)""")
def batch_status_map(spark: SparkSession, d: str) -> DataFrame:
    states = [x.strip("'[]") for x in _STATES.split(",")]
    state = F.element_at(F.array(*map(F.lit, states)), (1 + F.col("event_id") % 10).cast("int"))
    return table(spark, d, "events").select("event_id", X.status_name(state).alias("status"))


def _first_word(prompt: str) -> str:
    """A model that reads the first word of the content."""
    import json
    import re

    m = re.match(r"##Content\n\n([A-Za-z]+)", prompt)
    return json.dumps({"first": m.group(1)} if m else {})


def _last_candidate(prompt: str) -> str:
    """A model that settles a conflict by the last candidate."""
    import json

    line = next(x for x in prompt.split("\n") if x.startswith("first: "))
    return json.dumps({"first": {"value": line.removeprefix("first: ").split(" | ")[-1], "confidence": 9}})


@query(
    f"""SELECT conv_id, coalesce(arg_max(tok, p), '') AS first FROM (SELECT conv_id, nullif(regexp_extract(content, '^[A-Za-z]+'), '') AS tok, min(page_no) AS p FROM {_CONV} GROUP BY 1, 2) GROUP BY 1"""
)
def model_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A call a page, merged; what pages contradict each other in is settled by a second model."""
    p = _conversation_pages(spark, d).select("conv_id", "page_no", "content")
    return Documents(p, "conv_id").resolve(_first_word, schema.contract("first STRING"), _last_candidate)


_SPEAKS = "CASE WHEN contains(lower(text), '{a}') THEN '{x}' WHEN contains(lower(text), '{b}') THEN '{y}' ELSE 'Unknown' END"


@query(
    f"""WITH v AS (SELECT doc_id, {_SPEAKS.format(a='the', x='english', b='und', y='german')} AS a, {_SPEAKS.format(a='and', x='english', b='der', y='german')} AS b, {_SPEAKS.format(a='que', x='romance', b='zz', y='none')} AS c FROM documents)
SELECT doc_id, CASE WHEN a = b THEN a ELSE c END AS name, CASE WHEN a = b THEN CASE a WHEN 'english' THEN 9 WHEN 'german' THEN 8 ELSE 1 END ELSE CASE c WHEN 'romance' THEN 7 WHEN 'none' THEN 2 ELSE 1 END END::INTEGER AS confidence,
CASE WHEN a = b THEN 0 ELSE 1 END::INTEGER AS layer FROM v"""
)
def model_layers(spark: SparkSession, d: str) -> DataFrame:
    """Two models asked about all documents, a third about those on which they differ."""
    p = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("content"))
    first = [model.KeywordBackend([("the", "english", 9), ("und", "german", 8)]), model.KeywordBackend([("and", "english", 9), ("der", "german", 8)])]
    return Documents(p).classify([first, [model.KeywordBackend([("que", "romance", 7), ("zz", "none", 2)])]])


@query(f"SELECT doc_id, nullif(regexp_extract(text, '[0-9]{{3,}}'), '') AS digits FROM documents WHERE {_strip('text')} <> ''")
def model_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A call a chunk; the first chunk that has the field gives it."""
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return model.extracted_by_chunk(t, model.RegexBackend({"digits": r"([0-9]{3,})"}), schema.contract("digits STRING"), "doc_id", 200)


@query(f"SELECT conv_id, page_no, CASE WHEN content = '' THEN '' WHEN page_no % 3 = 0 THEN '<!-- Error processing page ' || page_no || ': ValueError: no -->' ELSE '# ' || content END AS markdown FROM {_CONV}")
def model_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A call a page; one that fails leaves a comment."""
    p = _conversation_pages(spark, d).select("conv_id", "page_no", F.concat(F.when(F.col("page_no") % 3 == 0, "!").otherwise(""), "content").alias("content"))

    def backend(prompt: str) -> str:
        content = prompt.split("\n\n", 1)[1]
        if content.startswith("!") and len(content) > 1:
            raise ValueError("no")
        return "" if content in ("", "!") else "# " + content

    return model.as_markdown(p, backend, "conv_id")


@query(f"SELECT count(*) AS documents, round(avg(w::INTEGER), 9) AS accuracy FROM (SELECT doc_id, bool_and(matched) AS w FROM ({_LONG}) GROUP BY 1)")
def evaluation_run(spark: SparkSession, d: str) -> DataFrame:
    """Documents, predictions and labels to results in one call."""
    p = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("content"))
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id").withColumn("parity", F.col("doc_id") % 2)
    fields = ["quality", "toxic", "parity"]
    wide = _predicted(spark, d).groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("predicted"))).alias(f) for f in fields])
    config = spark.createDataFrame([("toxic", "NUMERIC", 0.8, 0.01)], "field string, kind string, threshold double, tolerance double")
    return Documents(p).evaluate(wide, labels, fields, config)["documents"].withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT doc_id, base64(encode(text)) AS encoded, text AS plain FROM documents")
def base64_round_trip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.data_uri(F.encode("text", "UTF-8"), "text/plain").alias("uri"))
    b = X.without_data_uri(F.col("uri"))
    return t.select("doc_id", b.alias("encoded"), F.decode(F.unbase64(b), "UTF-8").alias("plain"))


@query("SELECT doc_id, substring(text, 5, 10) AS part, left(text, 50) AS head FROM documents")
def offset_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.anchored(F.col("text"), F.lit(4), F.lit(14)).alias("part"), X.prefix(F.col("text"), 50).alias("head"))


# --- HTML


def _no(x: str, tags: tuple[str, ...] = X.REMOVED) -> str:
    return f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '(?is){'|'.join(rf'<{t}\b[^>]*>.*?</{t}\s*>' for t in tags)}', '', 'g')"


def _plain(x: str) -> str:
    for e, s in X._ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, e.replace("'", "''"), s.replace("'", "''"))
    return x


def _line(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\x0B\\x0C\\r]|  '), lambda z: {_strip('z')}), lambda z: z <> ''), ' ')"


def _tagless(x: str) -> str:
    return _plain(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')")


@query(f"SELECT page_id, {_no('html')} AS html FROM pages")
def html_remove_elements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.without_elements(F.col("html")).alias("html"))


@query(f"SELECT page_id, {_line(_tagless(_no('html')))} AS content FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("content"))


@query(f"SELECT page_id, {_line(_tagless(_no('html', X.REMOVED + X.HEADERS)))} AS content FROM pages")
def html_summarized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.html_text(F.col("html"), "summarize").alias("content"))


_H = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in X.HEADERS)


@query(f"SELECT page_id, array_to_string(list_transform(regexp_extract_all({_no('html')}, '{_H}'), lambda z: {_strip(_tagless('z'))}), ' / ') AS headers FROM pages")
def html_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(X.html_headers(F.col("html")), " / ").alias("headers"))


@query()
def html_parsed_truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.truncated(500)(X.parsed_html_text()("html")).alias("content"))


@query(
    r"""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+') AS is_url, lower(regexp_extract(split_part(url, '?', 1), '\.([^./\\]+)$', 1)) AS ext,
regexp_extract(split_part(url, '?', 1), '[^/]*$', 0) AS name FROM pages"""
)
def url_predicate(spark: SparkSession, d: str) -> DataFrame:
    path = F.split_part(F.col("url"), F.lit("?"), F.lit(1))
    return table(spark, d, "pages").select("page_id", X.is_url(F.col("url")).alias("is_url"), X.extension(path).alias("ext"), X.basename(path).alias("name"))


_SEEN = "['text/html','application/pdf','image/jpeg','text/x-unknown','application/vnd.ms-excel']"


@query(
    f"""SELECT page_id, m AS mime, CASE m WHEN 'text/html' THEN 'htm' WHEN 'application/pdf' THEN 'pdf' WHEN 'image/jpeg' THEN 'jpeg' WHEN 'application/vnd.ms-excel' THEN 'xls' ELSE 'txt' END AS ext,
m IN ('application/pdf', 'text/html', 'application/xhtml+xml') AS accepted FROM (SELECT page_id, {_SEEN}[1 + page_id % 5] AS m FROM pages)"""
)
def mime_lookup(spark: SparkSession, d: str) -> DataFrame:
    seen = ["text/html", "application/pdf", "image/jpeg", "text/x-unknown", "application/vnd.ms-excel"]
    t = table(spark, d, "pages").select("page_id", F.element_at(F.array(*map(F.lit, seen)), (1 + F.col("page_id") % 5).cast("int")).alias("mime"))
    return t.select("page_id", "mime", mime.extension_of(F.col("mime")).alias("ext"), mime.accepts(F.col("mime"), ["pdf", "html"]).alias("accepted"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' END AS kind, page_id % 4 = 0 AS pdf FROM pages"""
)
def magic_bytes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 4
    start = F.when(i == 0, F.unhex(F.lit("255044462D312E34"))).when(i == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(i == 2, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.encode("html", "UTF-8"))
    return table(spark, d, "pages").select("page_id", X.sniffed(start).alias("kind"), X.is_pdf(start).alias("pdf"))


# --- tables and forms

_CUST = "concat_ws(' | ', c_custkey::VARCHAR, c_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END)"


@query(f"SELECT c_nationkey, string_agg({_CUST}, chr(10) ORDER BY c_custkey) AS content FROM customer WHERE c_custkey > 10 GROUP BY 1")
def table_render(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    for col in ("c_name", "c_mktsegment", "key"):
        blank = F.col("c_custkey") <= 10 if col != "c_mktsegment" else (F.col("c_custkey") <= 10) | (F.col("c_custkey") % 5 == 0)
        c = c.withColumn(col, F.when(~blank, F.col("c_custkey").cast("string") if col == "key" else F.col(col)))
    return tables.rendered_sheet(c, "c_nationkey", "c_custkey", ["key", "c_name", "c_mktsegment"])


@query(
    """SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY 1"""
)
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("r")).groupBy("n_regionkey").agg(pages.ordered("r", "n_nationkey").alias("rows"))
    return g.select("n_regionkey", tables.markdown_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.col("rows"))).alias("content"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END::INTEGER AS tables, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name || '|' END AS row FROM supplier""")
def table_clean(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" "), F.col("s_name"), F.lit("\n")))
    dirty = F.array(F.array(F.array(name, F.lit(None).cast("string")), F.array(F.lit(" "), F.lit(None).cast("string"))), F.array(F.array(F.lit(""))))
    t = table(spark, d, "supplier").select("s_suppkey", tables.cleaned(dirty).alias("t"))
    return t.select("s_suppkey", F.size("t").alias("tables"), F.coalesce(F.array_join(F.get(F.get("t", F.lit(0)), F.lit(0)), "|"), F.lit("")).alias("row"))


@query("""SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '# ' || text WHEN 'user' THEN '- ' || text ELSE text END, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1""")
def elements_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("role") == "system", "TITLE").when(F.col("role") == "user", "LIST_ITEM").otherwise("TEXT")
    return tables.elements_markdown(table(spark, d, "conversations").withColumn("label", label), "conv_id", "turn")


@query(
    """WITH b AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS page_no FROM conversations)
SELECT conv_id, page_no::BIGINT AS page_no, string_agg(text, chr(10) ORDER BY turn) AS content FROM b WHERE role = 'assistant' GROUP BY 1, 2"""
)
def textract_page_lines(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "PAGE").when(F.col("role") == "assistant", "LINE").otherwise("OTHER")
    return tables.block_lines(table(spark, d, "conversations").withColumn("block_type", kind), "conv_id", "turn")


@query("SELECT c_custkey, 'segment of' AS key, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ' ' || c_name END AS value FROM customer")
def textract_form_join(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    block = lambda i, kind, text, kids=none, values=none: F.struct(F.lit(i).alias("block_id"), F.lit(kind).alias("block_type"), text.alias("text"), kids.alias("children"), values.alias("value_ids"))
    empty = F.lit(None).cast("string")
    ids = lambda *x: F.array(*map(F.lit, x))
    blocks = F.array(
        block("w1", "WORD", F.lit("segment")),
        block("w2", "WORD", F.lit("of")),
        block("w3", "WORD", F.col("c_mktsegment")),
        block("w4", "WORD", F.col("c_name")),
        block("k", "KEY", empty, ids("w1", "w2"), ids("v")),
        block("v", "VALUE", empty, F.when(F.col("c_custkey") % 4 != 0, ids("w3", "w4")).otherwise(none)),
    )
    t = table(spark, d, "customer").select("c_custkey", F.explode(blocks).alias("b")).select("c_custkey", "b.*")
    return tables.form_fields(t, "c_custkey")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber AS r, 1 + l_partkey % 3 AS c, max(l_returnflag) AS t FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT l_orderkey, max(r) AS mr, max(c) AS mc FROM c GROUP BY 1),
g AS (SELECT l_orderkey, unnest(range(1, mr + 1)) AS r, mc FROM s), h AS (SELECT l_orderkey, r, unnest(range(1, mc + 1)) AS c FROM g),
l AS (SELECT h.l_orderkey, h.r, string_agg(coalesce(t, ''), ',' ORDER BY h.c) AS line FROM h LEFT JOIN c ON c.l_orderkey = h.l_orderkey AND c.r = h.r AND c.c = h.c GROUP BY 1, 2)
SELECT l_orderkey, string_agg(line, ';' ORDER BY r) AS rows FROM l GROUP BY 1"""
)
def table_pivot(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.col("l_partkey") % 3).alias("col"), "l_returnflag")
    out = tables.built_tables(t, ["l_orderkey"], "l_linenumber", "col", "l_returnflag")
    return out.select("l_orderkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


@query("SELECT l_orderkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber = 1")
def lines_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return tables.lines_outside_tables(t, t.where("l_linenumber = 1"), ["l_orderkey"], "l_returnflag", "l_returnflag")


@query(
    f"""WITH p AS (SELECT l_orderkey, pos AS place, l_returnflag AS key, l_linestatus AS value, CASE WHEN l_partkey % 3 = 0 THEN [] ELSE [1 + l_partkey % 2] END AS regions FROM {_LINES}),
n AS (SELECT DISTINCT l_orderkey, unnest([1, 2]) AS page_no FROM lineitem)
SELECT l_orderkey, page_no, key, arg_max(value, place) AS value FROM n JOIN p USING (l_orderkey) WHERE len(regions) = 0 OR list_contains(regions, page_no) GROUP BY 1, 2, 3"""
)
def key_values_of_page(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d)
    regions = F.when(F.col("l_partkey") % 3 != 0, F.array((1 + F.col("l_partkey") % 2).cast("int")))
    p = t.select("l_orderkey", F.col("pos").alias("place"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"), regions.alias("regions"))
    two = t.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"))
    return tables.pairs_of_page(p, two, "l_orderkey")


@query(
    """SELECT p_partkey, h, ceil(h / 1000)::BIGINT AS tiles, h - (ceil(h / 1000)::BIGINT - 1) * 1000 AS last_height, floor(CASE WHEN h > 800 THEN h * (800 / h) ELSE h END)::BIGINT AS scaled_height, greatest(20, least(40, p_size * 4))::BIGINT AS col_width
FROM (SELECT p_partkey, p_size, 1 + (p_partkey * 37) % 5000 AS h FROM part)"""
)
def image_geometry(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", "p_size", (1 + F.col("p_partkey") * 37 % 5000).alias("h"))
    t = t.withColumn("t", N.tiles(F.col("h")))
    last = F.element_at("t", -1)
    return t.select("p_partkey", "h", F.size("t").cast("long").alias("tiles"), (last["bottom"] - last["top"]).alias("last_height"), N.scaled(F.lit(1), F.col("h"), 800)["height"].alias("scaled_height"), N.column_width(F.col("p_size")).alias("col_width"))


# --- the whole way: render, extract, evaluate


@query(
    """SELECT o_orderkey, o_orderkey AS number, o_orderpriority AS priority, round(o_totalprice, 2) AS total, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, true AS schema_valid FROM orders"""
)
def invoice_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders rendered as invoices, extracted again by the offline backend, so that the tables are the truth."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.format_string("INVOICE\nNumber: %d\nPriority: %s\nLines: %d\nTotal: %.2f\n", "o_orderkey", "o_orderpriority", F.coalesce("n", F.lit(0)), "o_totalprice")
    backend = model.RegexBackend({"number": r"^Number: (\d+)$", "priority": r"^Priority: (.+)$", "lines": r"^Lines: (\d+)$", "total": r"^Total: ([0-9.]+)$"})
    fields = schema.contract("number STRING, priority STRING, total STRING, lines STRING")
    got = model.extracted(o.select("o_orderkey", text.alias("content")), backend, fields, "o_orderkey")
    return got.select("o_orderkey", F.col("number").cast("long").alias("number"), "priority", F.col("total").cast("double").alias("total"), F.col("lines").cast("long").alias("lines"), "schema_valid")


@query(f"SELECT l_orderkey, arg_min(l_returnflag, pos) AS flag, arg_min(l_linestatus, pos) AS status FROM {_LINES} GROUP BY 1")
def paginate_extract(spark: SparkSession, d: str) -> DataFrame:
    """Each line of an order as a page of its own, extracted page by page and merged."""
    t = _lines(spark, d).select("l_orderkey", F.col("pos").alias("page_no"), F.format_string("Flag: %s\nStatus: %s", "l_returnflag", "l_linestatus").alias("content"))
    backend = model.RegexBackend({"flag": r"^Flag: (\w+)$", "status": r"^Status: (\w+)$"})
    return model.extract(t, backend, schema.contract("flag STRING, status STRING"), "l_orderkey", model.PAGINATE)
