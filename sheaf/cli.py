"""``spark-submit -m sheaf.cli config.json``: extract from documents and evaluate against labels.

The configuration names ``documents`` (files or a folder), ``labels`` (JSON keyed by file name), ``contract`` (DDL), ``patterns`` (field to pattern, for the
offline backend), optional ``fields`` (field to kind, threshold and tolerance), ``name`` and ``output`` (a folder for the report).
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import schema
from sheaf.functions import text as X
from sheaf.operators import model
from sheaf.operators.store import written
from sheaf.plans.documents import Documents
from sheaf.sources import files


def run(spark: SparkSession, config: dict, backend: model.Backend | None = None) -> dict[str, DataFrame]:
    missing = [k for k in ("documents", "labels", "contract") if k not in config]
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    contract = schema.contract(config["contract"])
    names = [f.name for f in contract.fields]
    pages = files.load_folder(spark, config["documents"]).where("content is not null")
    pages = written(pages.withColumn("doc_id", X.basename(F.col("path"))).select("doc_id", "page_no", "content"))
    docs = Documents(pages)
    found = written(docs.extract(backend or model.RegexBackend(config.get("patterns", {})), contract))
    labels = files.read_labels(spark, config["labels"]).select("doc_id", F.from_json("expected", contract).alias("e")).select("doc_id", "e.*")
    kinds = [(f, c.get("kind", "EXACT"), float(c.get("threshold", 0.8)), float(c.get("tolerance", 0.01))) for f, c in config.get("fields", {}).items()]
    rules = spark.createDataFrame(kinds, "field string, kind string, threshold double, tolerance double")
    out = docs.evaluate(found.where("schema_valid").select("doc_id", *names), labels, names, rules, config.get("name", "evaluation"))
    if "output" in config:
        out["report"].select("report").write.mode("overwrite").text(config["output"])
    return out


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__)
        return 2
    with open(args[0], encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("sheaf").getOrCreate()
    print(run(spark, config)["report"].first()["report"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
