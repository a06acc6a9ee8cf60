"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

The index is a log-structured set of runs. A run is a table of line hashes
sorted by hash. A batch of documents is first merge-anti-joined with the runs:
hashes that no run holds become the batch's own run on level 0, hashes that
are known go to a tally beside the runs. When a level holds ``fanout`` runs
they are merged into one run of the next level, so a look-up reads a number of
runs that grows with the logarithm of the batches.

Runs hold each hash once, so only three kinds of rows can decide a line: run
entries already seen in ``min_docs`` documents, tallies, and the run entries
the tallies point to. All other lines never leave their own batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import ASCII_SPACE, fold_ascii, fresh_name, let, require, text_or_empty
from .scratch import discard, materialize

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return fold_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def line_table(docs: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """One row per keyed line: 128-bit hash, document, fingerprint of its text, position.

    Rows without doc_id take no part. The text's fingerprint keeps rows apart
    that repeat a doc_id with another text.
    """
    text = text_or_empty("text")
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id"), F.xxhash64(text).alias("row_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    return keyed.select(
        F.xxhash64("k").alias("h1"),
        F.xxhash64(F.lit(7), F.col("k")).alias("h2"),
        "doc_id",
        "row_hash",
        "pos",
        F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(batches)).cast("int").alias("batch"),
    )


class LineRuns:
    """The levelled index. Entries: hash, documents that hold it, largest doc_id."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.tallies: list[DataFrame] = []

    def runs(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    def tally(self) -> DataFrame | None:
        out = None
        for t in self.tallies:
            out = t if out is None else out.unionByName(t)
        return out

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join a batch of ``line_table`` rows with the runs and add its own."""
        entries = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        known = self.runs()
        if known is None:
            fresh = entries
        else:
            entries = materialize(entries, "line-batch")
            fresh = entries.join(known.select(*KEY), KEY, "left_anti")
            self.tallies.append(materialize(entries.join(known.select(*KEY), KEY, "left_semi"), "line-tally"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(materialize(fresh.sortWithinPartitions(*KEY), "line-run"))
        if known is not None:
            discard(self.spark, entries)
        self._compact()

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            level = self.levels[depth]
            if len(level) < self.fanout:
                continue
            merged = level[0]
            for run in level[1:]:
                merged = merged.unionByName(run)
            # Runs are disjoint: merging them is a range partitioning and a sort, without an aggregate.
            target = materialize(merged.repartitionByRange(*KEY).sortWithinPartitions(*KEY), "line-run")
            for run in level:
                discard(self.spark, run)
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(target)
            self.levels[depth] = []

    def fresh_lines(self, lines: DataFrame) -> DataFrame:
        """Incremental form: the lines of a batch whose hash no run holds yet (before ``add``)."""
        known = self.runs()
        return lines if known is None else lines.join(known.select(*KEY), KEY, "left_anti")

    def repeated(self, min_docs: int) -> DataFrame:
        """Hashes in at least ``min_docs`` documents and the largest doc_id of each."""
        runs, tally = self.runs(), self.tally()
        alone = runs.where(F.col("n_docs") >= min_docs)
        if tally is None:
            return alone.select(*KEY, "keeper")
        touched = tally.select(*KEY).distinct()
        met = runs.where(F.col("n_docs") < min_docs).join(touched, KEY, "left_semi")
        rows = alone.unionByName(met).unionByName(tally)
        total = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return total.where(F.col("n_docs") >= min_docs).select(*KEY, "keeper")


def without_positions(lines: Column, drops: Column) -> Column:
    """``lines`` without the 0-based, ascending positions ``drops``, in linear time."""
    edges = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(lines)))
    return let(
        F.struct(lines.alias("lines"), edges.alias("edges")),
        lambda x: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(x["edges"]) - 2),
                lambda i: F.slice(x["lines"], F.get(x["edges"], i) + 2, F.get(x["edges"], i + 1) - F.get(x["edges"], i) - 1),
            )
        ),
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 3, broadcast_rows: int = 500_000
) -> DataFrame:
    """Drop the lines that many documents hold, but in the largest doc_id that holds them.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines except in the largest doc_id.

    Returns the columns of ``docs`` with the kept text, and ``n_lines`` (before
    dropping) and ``n_dropped``. A null text counts as one empty line and comes
    back empty. Rows that repeat a doc_id count as one document. A row without
    doc_id takes no part and keeps its lines. Columns of the input named
    ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty one.

    The repeated hashes are written before the lines are joined with them. At
    most ``broadcast_rows`` of them (counted) are broadcast, so that the lines
    stay where they are; more are joined by a shuffle of two written tables,
    whose hot hashes adaptive execution splits.
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    staged = materialize(line_table(docs, min_chars, batches), "lines", ["batch"])
    index = LineRuns(spark, fanout)
    for batch in range(batches):
        index.add(staged.where(F.col("batch") == batch))
    repeated = materialize(index.repeated(min_docs), "line-repeated")
    repeated = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    names = docs.columns
    doc, row, hash_, gone = (fresh_name(docs, "line", n) for n in ("doc", "row", "hash", "drops"))
    drops = (
        staged.drop("batch")
        .join(repeated, KEY)
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias(doc), F.col("row_hash").alias(row))
        .agg(F.sort_array(F.collect_set("pos")).alias(gone))
    )
    text = text_or_empty("text")
    joined = docs.withColumn(hash_, F.xxhash64(text)).join(drops, (F.col("doc_id") == F.col(doc)) & (F.col(hash_) == F.col(row)), "left")
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(without_positions(lines, F.col(gone)), "\n"))
    return joined.select(
        *[kept.alias("text") if n == "text" else F.col(f"`{n}`") for n in names],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
