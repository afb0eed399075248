"""From raw documents to packed training windows, in stages.

Each stage takes (spark, docs, sf_dir), with docs what the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In all stages rows that repeat are judged each, texts of any length whole, and an empty table gives an empty result; labels and benchmark may be empty, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import decontaminate, ngram_join, packing, quality, repeats, storage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled quality classifier keeps. Null, empty and blank texts go; rows without an id are judged like others."""
    return quality.only_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class that the n-gram Jaccard join connects. Rows without an id or without words stay."""
    return ngram_join.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place, has; a text of which nothing is left goes. Rows without an id stay as they are."""
    return repeats.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and no paraphrase of one. Rows without an id, and null and empty texts, stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids, with the documents and places that they come from. Rows without an id and empty texts are in no window."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_windows),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            docs = storage.stash(out)
            storage.discard(spark, before)
        else:
            now: list[str] = []
            docs = storage.stash(out, now)
            storage.discard(spark, before)
            before = now
    return docs
