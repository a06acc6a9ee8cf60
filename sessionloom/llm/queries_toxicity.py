"""Query of the toxicity grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .toxicity import fit_toxicity, score_toxicity


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", "expected_severity", "grade", "toxic")
