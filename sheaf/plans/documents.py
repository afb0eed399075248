"""A fluent front: load, split, classify, extract, all of it lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from sheaf.operators import classify, evaluate, model, split
from sheaf.operators.pages import joined, with_page_guard
from sheaf.operators.store import written
from sheaf.sources import files


class Documents:
    """Pages of documents, (key, page_no, content), and the steps over them. Steps give DataFrames or new Documents."""

    def __init__(self, pages: DataFrame, key: str = "doc_id") -> None:
        self.pages, self.key = pages, key

    @classmethod
    def load(cls, spark: SparkSession, path: str, loader: str | None = None, **options: object) -> Documents:
        return cls(files.load(spark, path, loader, **options), "path")

    def hook(self, *hooks: Callable[[DataFrame], DataFrame]) -> Documents:
        return Documents(model.hooked(self.pages, *hooks), self.key)

    def guard(self, least: int = 2) -> DataFrame:
        return with_page_guard(self.pages, self.key, least)

    def text(self) -> DataFrame:
        return joined(self.pages, self.key)

    def split_lazy(self, same: Column, first: Column, second: Column) -> DataFrame:
        """Groups by verdicts on neighbouring pages; a document of one page is one group."""
        return split.lazy_groups(split.verdicts(self.pages, same, first, second, self.key), self.key)

    def split_eager(self, backend: model.Backend) -> DataFrame:
        """Groups by one call a document."""
        prompts = split.eager_prompts(self.pages, self.key).withColumnRenamed("content", "prompt")
        return split.eager_groups(model.asked(prompts, backend), self.key)

    def classify(self, layers: list[list[model.Backend]], strategy: str = classify.CONSENSUS, threshold: float | None = None, store: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
        """(key, name, confidence, layer): later layers are asked about what earlier ones leave open. ``store`` writes and rereads each layer, so that no model is asked twice."""
        key = self.key

        def ask(backends: list[model.Backend]) -> Callable[[DataFrame], DataFrame]:
            def votes(docs: DataFrame) -> DataFrame:
                from pyspark.sql import functions as F

                out = None
                for k, b in enumerate(backends):
                    v = model.classified(docs, b, key).withColumn("model_ord", F.lit(k))
                    out = v if out is None else out.unionByName(v)
                return out

            return votes

        return classify.through_layers(self.text(), [ask(b) for b in layers], key, strategy, threshold, store)

    def extract(self, backend: model.Backend, contract: T.StructType, strategy: str = model.FORBIDDEN) -> DataFrame:
        return model.extract(self.pages, backend, contract, self.key, strategy)

    def extract_groups(self, groups: DataFrame, contracts: dict[str, tuple[T.StructType, model.Backend]]) -> dict[str | None, DataFrame]:
        """One typed table a class: the groups of that class, extracted by its contract. Under None are (group_key, classification, status) of groups without a contract or pages."""
        from pyspark.sql import functions as F

        rows = split.group_pages(groups, self.pages, self.key).withColumn("group_key", F.concat_ws("#", F.col(self.key).cast("string"), "group_no"))
        out: dict[str | None, DataFrame] = {name: model.extract(rows.where(F.col("classification") == name), b, c, "group_key") for name, (c, b) in contracts.items()}
        keyed = groups.select(F.concat_ws("#", F.col(self.key).cast("string"), "group_no").alias("group_key"), "classification")
        known = F.coalesce(F.col("classification").isin(*contracts), F.lit(False))
        lost = keyed.join(rows.select("group_key").distinct().withColumn("there", F.lit(True)), "group_key", "left").where(~known | F.col("there").isNull())
        out[None] = lost.select("group_key", "classification", F.when(known, "no_pages").otherwise("no_contract").alias("status"))
        return out

    def resolve(self, backend: model.Backend, contract: T.StructType, judge: model.Backend) -> DataFrame:
        """Page by page as PAGINATE, but ``judge`` is asked about conflicts."""
        merged = written(model.extracted_by_page(self.pages, backend, contract, self.key))
        return model.resolve_conflicts(merged, self.pages, judge, self.key, [f.name for f in contract.fields])

    def markdown(self, backend: model.Backend) -> DataFrame:
        return model.as_markdown(self.pages, backend, self.key)

    def evaluate(self, predicted: DataFrame, labels: DataFrame, fields: list[str], config: DataFrame, name: str = "evaluation") -> dict[str, DataFrame]:
        """Predictions of this set against labels, in one call: see ``evaluate.evaluated``."""
        return evaluate.evaluated(self.text(), predicted, labels, fields, config, self.key, name)
