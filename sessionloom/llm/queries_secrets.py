"""Query and SQL of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_scan import KINDS, scan_secrets, spell


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    scanned = scan_secrets(docs)
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    bare = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scanned.select(
        "doc_id",
        *[count(k.name) for k in KINDS],
        F.sha2(spell(bare), 256).alias("base_sha256"),
        spell(F.sort_array(F.concat(bare, "classed"))).alias("spans"),
    )
