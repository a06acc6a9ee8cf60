"""Query of the byte-level BPE encoding and decoding."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import KNOWN, encode_tokens

try:  # the pattern of the rank file below
    from public_tokenizers import PATTERN
except ModuleNotFoundError as missing:  # only the files are here, in SESSIONLOOM_TOKENIZERS
    if missing.name != "public_tokenizers":
        raise
    PATTERN = KNOWN


def rank_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """A public vocabulary file: of the installed package, or of the folder SESSIONLOOM_TOKENIZERS."""
    folder = os.environ.get("SESSIONLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digests(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    return encode_tokens(docs, path, pattern, keep=["doc_id"], decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), rank_path())
