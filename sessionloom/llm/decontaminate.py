"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles (powers of two). An
item's signature is its ``sketch`` smallest shingle hashes. A signature hash is
a uniform draw from the item, so the share of an item's signature that a
document holds estimates the containment of the item in it, however long the
document is: the document is looked through whole, shingle by shingle, and its
length doesn't blur the estimate. Each item sets how many signature hashes a
candidate must hold: with containment t and n shingles, a document misses at
most floor((1-t)*n) of them, so the signature's size less that many are
certain. Signatures of longer items are longer by as much as they may miss, so
that at least ``SURE`` hits are certain at every size, and no link is lost.

Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fresh_name, require, shingle_hashes, text_or_empty, word_array
from .scratch import materialize


#: Signature hashes that every true match of an item of more shingles holds for certain.
SURE = 4


def signature_size(n: int, sketch: int, threshold: float) -> int:
    """Hashes in the signature of an item of ``n`` shingles."""
    return min(n, max(sketch, math.floor((1 - threshold) * n + 1e-9) + SURE))


def needed_hits(n: int, sketch: int, threshold: float) -> int:
    """Signature hashes that a document with at least ``threshold`` of an item of ``n`` shingles holds for certain."""
    return signature_size(n, sketch, threshold) - math.floor((1 - threshold) * n + 1e-9)


def item_signatures(benchmark: DataFrame, width: int, sketch: int, threshold: float) -> DataFrame:
    """item_id, n_item, part, shingles, signature, needed (as ``needed_hits``); items without a shingle are left out."""
    shingles = F.array_distinct(shingle_hashes(word_array(text_or_empty("text")), width))
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", shingles.alias("shingles"))
    # Rows that repeat an item_id are one item.
    items = items.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    items = items.where(F.size("shingles") > 0)
    size = F.size("shingles")
    misses = F.floor(F.lit(1 - threshold) * size + F.lit(1e-9)).cast("int")
    taken = F.least(size, F.greatest(F.lit(sketch), misses + SURE))
    return items.select(
        "item_id", size.cast("long").alias("n_item"), F.floor(F.log2(size)).cast("int").alias("part"), "shingles",
        F.slice(F.sort_array("shingles"), F.lit(1), taken).alias("signature"), (taken - misses).cast("long").alias("needed"),
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, sketch: int = 16,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Pairs of documents and the benchmark items that they contain.

    A pair counts when the document holds at least ``threshold`` of the item's
    distinct ``width``-word shingles. Returns doc_id, item_id, n_item (the
    item's shingles) and n_shared, one row for each pair.

    Null and empty texts, and items of fewer than ``width`` words, match
    nothing. Rows without doc_id or item_id take no part. Rows that repeat a
    doc_id each count by themselves, the best of them decides. Empty tables
    give an empty one; further columns are ignored. Signatures and candidates
    are broadcast if they have at most ``broadcast_rows`` rows (counted), else
    joined by shuffles.
    """
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    items = materialize(item_signatures(benchmark, width, sketch, threshold), "benchmark")
    signatures = items.select("item_id", "n_item", "needed", F.explode("signature").alias("h"))
    total = items.agg(F.coalesce(F.sum(F.size("signature")), F.lit(0))).first()[0]
    signatures = F.broadcast(signatures) if total <= broadcast_rows else signatures
    whole = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    shingles = shingle_hashes(word_array(F.col("text")), width)
    exploded = whole.select("doc_id", F.explode(shingles).alias("h"))
    hits = (
        exploded.join(signatures, "h")
        .groupBy("doc_id", "item_id", "needed")
        .agg(F.count_distinct("h").alias("n_hits"))
        .where(F.col("n_hits") >= F.col("needed"))
    )
    candidates = materialize(hits.select("doc_id", "item_id"), "leak-candidates")
    pairs = F.broadcast(candidates) if candidates.count() <= broadcast_rows else candidates
    verified = (
        whole.join(pairs, "doc_id")
        .join(items.select("item_id", "n_item", F.col("shingles").alias("item_shingles")), "item_id")
        .withColumn("n_shared", F.size(F.array_intersect("item_shingles", shingles)).cast("long"))
        .where(F.col("n_shared") >= F.lit(threshold - 1e-12) * F.col("n_item"))
    )
    return verified.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item (see ``contaminated``).

    All columns and all other rows stay as they are; rows without doc_id stay.
    """
    leak = fresh_name(docs, "leak")
    leaks = contaminated(docs, benchmark, width, threshold).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col(leak), "left_anti")
