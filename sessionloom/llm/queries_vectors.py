"""Query of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .hnsw import search_vectors


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
