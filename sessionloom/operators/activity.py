"""Run-length and sessionization operators of activity series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import r6

STEP_MS = 40


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int = 2) -> DataFrame:
    """Centred mean of ``value`` (integer units), shortened at the edges: sum and count as ``total`` and ``n``."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumns({"total": F.sum(value).over(w), "n": F.count(value).over(w)})


def _runs(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    every, same = W.partitionBy(*keys).orderBy("p"), W.partitionBy(*keys, flag).orderBy("p")
    return df.withColumn("__run", F.row_number().over(every) - F.row_number().over(same))


def postprocess(df: DataFrame, keys: list[str], order: list[str], flag: Column, bridge: int, least: int) -> DataFrame:
    """Bridge interior gaps of at most ``bridge`` rows, then drop runs under ``least``: ``active``."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("p", F.row_number().over(w.orderBy(*order))).withColumn("__x", flag).withColumn("__last", F.count(F.lit(1)).over(w))
    rows = _runs(rows, keys, "__x")
    run = W.partitionBy(*keys, "__x", "__run")
    fill = (~F.col("__x")) & (F.count(F.lit(1)).over(run) <= bridge) & (F.min("p").over(run) > 1) & (F.max("p").over(run) < F.col("__last"))
    rows = rows.withColumn("__y", F.col("__x") | fill).drop("__x", "__run")
    rows = _runs(rows, keys, "__y")
    keep = F.count(F.lit(1)).over(W.partitionBy(*keys, "__y", "__run"))
    return rows.withColumn("active", F.col("__y") & (keep >= least)).drop("__y", "__run", "__last")


def exclusive(df: DataFrame, keys: list[str], time: str, rank: list[Column]) -> DataFrame:
    """``winner``: the first row by ``rank`` in each 40 ms bucket (half to even) of a session."""
    bucket = F.rint(F.col(time) / STEP_MS).cast("bigint")
    marked = df.withColumn("bucket", bucket)
    return marked.withColumn("winner", F.row_number().over(W.partitionBy(*keys, "bucket").orderBy(*rank)) == 1)


def segments(df: DataFrame, keys: list[str], time: str, gap_ms: int = 80, score: str = "score_u") -> DataFrame:
    """Active rows of a key joined while at most ``gap_ms`` apart; the end is the last row's plus one step.

    Mean scores are given as ``score_sum`` and ``n`` of integer units.
    """
    w = W.partitionBy(*keys).orderBy(time)
    fresh = F.when(F.col(time) - F.lag(time).over(w) <= gap_ms, 0).otherwise(1)
    marked = df.withColumn("__f", fresh).withColumn("__g", F.sum("__f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        marked.groupBy(*keys, "__g")
        .agg(F.min(time).alias("start_ms"), (F.max(time) + STEP_MS).alias("end_ms"), F.count(F.lit(1)).alias("n"), F.sum(score).alias("score_sum"))
        .drop("__g")
    )


def speaking_phases(
    df: DataFrame, keys: list[str], until_ms: int | Column, confirm_ms: int = 200, silence_ms: int = 1000, step_ms: int = STEP_MS
) -> DataFrame:
    """Phases of the speaking state machine over a finished series, by islands.

    Rows: time ``t`` and boolean ``speaking``. A run of speaking samples (at
    most ``step_ms`` apart) of ``confirm_ms`` starts a phase at its first
    sample, if none is open; an open phase ends at the first silent moment after
    its last speaking sample, once ``silence_ms`` without speech have passed by
    the next confirmed run or ``until_ms``. Returns keys, started_ms, ended_ms
    (null: still open).
    """
    on = df.where("speaking").groupBy(*keys, "t").agg(F.lit(1).alias("one"))
    w = W.partitionBy(*keys).orderBy("t")
    fresh = F.when(F.col("t") - F.lag("t").over(w) <= step_ms, 0).otherwise(1)
    runs = (
        on.withColumn("__f", fresh).withColumn("__g", F.sum("__f").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "__g").agg(F.min("t").alias("s"), (F.max("t") + step_ms).alias("e"))
    )
    # A short run keeps an open phase alive, but opens none.
    v = W.partitionBy(*keys).orderBy("s")
    apart = F.when(F.col("s") - F.lag("e").over(v) < silence_ms, 0).otherwise(1)
    groups = runs.withColumn("__a", apart).withColumn("__h", F.sum("__a").over(v.rowsBetween(W.unboundedPreceding, 0)))
    phases = groups.groupBy(*keys, "__h").agg(F.min(F.when(F.col("e") - F.col("s") >= confirm_ms, F.col("s"))).alias("started_ms"), F.max("e").alias("e"))
    limit = until_ms if isinstance(until_ms, Column) else F.lit(until_ms)
    return phases.where(F.col("started_ms").isNotNull()).select(*keys, "started_ms", F.when(limit - F.col("e") >= silence_ms, F.col("e")).alias("ended_ms"))


def segment_records(df: DataFrame, keys: list[str], time: str, gap_ms: int, score: str, raw: str, tracklet: str) -> DataFrame:
    """``segments`` with mean score and raw score (six decimals) and the sorted tracklets of each."""
    w = W.partitionBy(*keys).orderBy(time, tracklet)
    fresh = F.when(F.col(time) - F.lag(time).over(w) <= gap_ms, 0).otherwise(1)
    marked = df.withColumn("__f", fresh).withColumn("__g", F.sum("__f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    mean = lambda c: r6(F.avg(c))
    return marked.groupBy(*keys, "__g").agg(
        F.min(time).alias("start_ms"), (F.max(time) + STEP_MS).alias("end_ms"), mean(score).alias("score"), mean(raw).alias("raw_score"),
        F.sort_array(F.collect_set(tracklet)).alias("tracklets"),
    ).drop("__g")


def score_records(df: DataFrame, session: list[str], order: list[str], prefix: str = "score-") -> DataFrame:
    """``df`` with ``record_id``, numbered by time, face and tracklet within a session."""
    n = F.row_number().over(W.partitionBy(*session).orderBy(*order))
    return df.withColumn("record_id", F.format_string(f"{prefix}%06d", n))


def ensemble_mean(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """Mean of the scores that several context lengths gave a sample; those that gave none don't count."""
    kept = F.filter(F.array(*scores), lambda x: x.isNotNull())
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    return df.select(*keys, F.when(F.size(kept) > 0, r6(mean)).alias("score"))


def observation_runs(df: DataFrame, keys: list[str], time: str, gap_ms: int = 500, least_ms: int = 160) -> DataFrame:
    """Runs of observations at most ``gap_ms`` apart, of two or more over ``least_ms``, with the whole steps inside.

    Returns keys, run (from 1, among all runs), n, first_step and last_step (multiples of a step).
    """
    w = W.partitionBy(*keys).orderBy(time)
    fresh = F.when(F.col(time) - F.lag(time).over(w) <= gap_ms, 0).otherwise(1)
    marked = df.withColumn("__f", fresh).withColumn("run", F.sum("__f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"))
    steps = runs.where((F.col("n") >= 2) & (F.col("b") - F.col("a") >= least_ms)).select(
        *keys, "run", "n", (F.ceil(F.col("a") / STEP_MS) * STEP_MS).alias("first_step"), (F.floor(F.col("b") / STEP_MS) * STEP_MS).alias("last_step")
    )
    return steps.where("last_step >= first_step")


def chained_segments(df: DataFrame, session: list[str], same: list[str], silence_ms: int) -> DataFrame:
    """Segments joined to the last one of their whole session if all of ``same`` agree and it ended at most ``silence_ms`` before.

    ``df``: start_ms, end_ms, score and the order ``n`` of arrival. A segment of
    anyone else in between keeps two apart. Returns the largest score of each.
    """
    w = W.partitionBy(*session).orderBy("n")
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.lag(c).over(w))
    turns = df.withColumn("__t", F.when(agree, 0).otherwise(1)).withColumn("__t", F.sum("__t").over(w.rowsBetween(W.unboundedPreceding, 0)))
    v = W.partitionBy(*session, "__t").orderBy("n")
    reach = F.max("end_ms").over(v.rowsBetween(W.unboundedPreceding, -1))
    marked = turns.withColumn("__f", F.when(F.col("start_ms") <= reach + silence_ms, 0).otherwise(1)).withColumn("__g", F.sum("__f").over(v.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*session, "__t", "__g", *same).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_parts")).drop("__t", "__g")


def median_smooth(df: DataFrame, keys: list[str], order: list[str], value: str, kernel: int = 13) -> DataFrame:
    """``df`` with ``smooth``: the running median of ``value``, the series continued by zeros at both ends.

    The kernel is the largest odd number of at most ``kernel`` and the rows of
    the key; series of fewer than three rows stay as they are.
    """
    radius = kernel // 2
    w = W.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("__p", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    near = placed.withColumn("__near", F.collect_list(F.struct("__p", F.col(value).cast("double").alias("v"))).over(w.rowsBetween(-radius, radius)))
    size = F.least(F.lit(kernel), F.col("__n") - (F.col("__n") % 2 == 0).cast("int"))
    held = F.transform(F.filter("__near", lambda x: F.abs(x["__p"] - F.col("__p")) * 2 < size), lambda x: x["v"])
    padded = F.array_sort(F.concat(held, F.array_repeat(F.lit(0.0), (size - F.size(held)).cast("int"))))
    median = F.element_at(padded, ((size + 1) / 2).cast("int"))
    return near.withColumn("smooth", F.when(F.col("__n") < 3, F.col(value).cast("double")).otherwise(median)).drop("__p", "__n", "__near")
