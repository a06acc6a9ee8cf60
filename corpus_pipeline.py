"""Corpus preparation: documents in, token ids out.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's docs, which are written as Parquet and read again.
Each stage works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.bpe import encode_tokens
from sessionloom.llm.decontaminate import decontaminate
from sessionloom.llm.line_dedup import dedup_lines
from sessionloom.llm.ngram_join import one_of_each
from sessionloom.llm.queries_tokens import PATTERN, rank_path
from sessionloom.llm.scratch import discard, new_path, scratch_scope
from sessionloom.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted severity model rejects go.

    A null or empty text has no features and stays unless the thresholds alone
    reject it; every row of a repeated doc_id is judged by its own text; rows
    without doc_id are judged but never trained on; an empty table stays empty.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters in three or more documents stay in the largest doc_id only.

    Every document stays, with the text that is left; n_chars follows the text.
    """
    kept = dedup_lines(docs).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard 0.8) stays.

    Documents without words, null texts and rows without doc_id have no copies
    and stay; rows that repeat a kept doc_id stay; an empty table stays empty.
    """
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null or empty texts hold none and stay, as do rows without doc_id that hold
    none; of a repeated doc_id all rows go if one of them holds an item; an
    empty table or an empty benchmark drops nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and digests of the ids and of the bytes they decode to.

    A null or empty text has no ids; every row gives one row, also of a
    repeated or missing doc_id; an empty table gives an empty one.
    """
    return encode_tokens(docs, rank_path(), PATTERN, keep=["doc_id"], decoded=True).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the fitted model or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's own tables and its predecessor's output are deleted once its
    output is written; of the whole run the last stage's input stays.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            discard(spark, docs)
        docs, last = spark.read.schema(docs.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
