"""The registered queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import chat, decontaminate, embeddings, lm_score, ngram_join, packing, quality, repeats, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_decontaminate_lsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pack_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.bits_per_byte(_table(spark, sf_dir, "documents"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(_table(spark, sf_dir, "conversations"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(_table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.vector_classes(_table(spark, sf_dir, "embeddings"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_quality_pu,
        op3_decontaminate_lsi,
        op4_pack_bounded,
        op5_shard_lpt,
        op6_context_mixing,
        op7_chat_snapshots,
        op8_ngram_join,
        op9_near_vectors,
        op10_repeated_passages,
    )
}

ORACLES: dict[str, str] = {
    "op7_chat_snapshots": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS w FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, w FROM c GROUP BY w),
p AS (SELECT DISTINCT w[1:i] AS pre FROM (SELECT w, unnest(range(1, len(w))) AS i FROM u))
SELECT conv_id, len(w)::BIGINT AS turns, array_to_string(list_transform(w, lambda b: '<|' || CASE WHEN b.r = '' THEN 'user'
    ELSE replace(replace(b.r, '<|', '< |'), '|>', '| >') END || '|>' || chr(10) || replace(replace(b.x, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10)), '') AS chat
FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pre = u.w)
""",
    "op9_near_vectors": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, min(vec_id) OVER (PARTITION BY embedding) AS first FROM embeddings WHERE vec_id IS NOT NULL),
f AS (SELECT vec_id, e FROM v WHERE vec_id = first),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b AS x, a AS y FROM p),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS least FROM r GROUP BY x),
l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT DISTINCT vec_id, least(first, coalesce(k.least, first)) AS class_id, coalesce(links, 0)::BIGINT AS links
FROM v LEFT JOIN k ON k.x = first LEFT JOIN l ON l.x = first
""",
    "op8_ngram_join": r"""
WITH RECURSIVE t AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY w) END AS first FROM t),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS gram FROM c WHERE doc_id = first AND len(w) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM i JOIN s ON s.doc_id = a JOIN s u ON u.doc_id = b WHERE k / (s.n + u.n - k)::DOUBLE >= 0.5),
e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b AS x, a AS y FROM p),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS least FROM r GROUP BY x),
l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT DISTINCT c.doc_id, least(first, coalesce(k.least, first)) AS class_id, coalesce(links, 0)::BIGINT AS links
FROM c LEFT JOIN k ON k.x = first LEFT JOIN l ON l.x = first
""",
    "op10_repeated_passages": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r\x1C-\x1F ]+'), lambda x: x <> '') AS w
      FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM t WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS h FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1 AS again, count(*) OVER (PARTITION BY h) AS n FROM h),
x AS (SELECT doc_id, pos, again,
      CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, again ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM r WHERE n > 1),
y AS (SELECT doc_id, pos, again, sum(new) OVER (PARTITION BY doc_id, again ORDER BY pos) AS island FROM x)
SELECT doc_id, min(pos)::INTEGER AS start_word, (max(pos) + 50)::INTEGER AS end_word, again FROM y GROUP BY doc_id, again, island
""",
}
