"""Interval algebra on rows with start_ms and end_ms, within the keys of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], gap_ms: int = 0, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``island``: overlapping or touching intervals (within ``gap_ms``) share a number."""
    w = W.partitionBy(*keys).orderBy("start_ms", "end_ms", *(order or []))
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start_ms") <= reach + gap_ms, 0).otherwise(1)
    return df.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__fresh")


def merge_intervals(df: DataFrame, keys: list[str], gap_ms: int = 0, ids: str | None = None) -> DataFrame:
    """Merged intervals; with ``ids`` (array column) the distinct ids in order of first occurrence."""
    marked = islands(df, keys, gap_ms)
    aggs = [F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_merged")]
    if ids:
        ordered = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", F.col(ids).alias("ids"))))
        aggs.append(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["ids"]))).alias(ids))
    return marked.groupBy(*keys, "island").agg(*aggs).drop("island")


def union_duration(df: DataFrame, keys: list[str], pad_ms: int = 0) -> DataFrame:
    """Length of the union; each interval is padded at its end first."""
    padded = df.withColumn("end_ms", F.col("end_ms") + pad_ms)
    return merge_intervals(padded, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int, closed_end: bool = False) -> DataFrame:
    """Pairs of intervals of equal ``keys`` that overlap, as an equi-join on time buckets.

    An interval is dealt to the buckets it touches; a pair is kept in the bucket
    where it begins to overlap, so it comes out once. Columns of the right side
    but the keys are prefixed with ``r_``. Adds overlap_start, overlap_end and
    overlap_ms.
    """
    stretch = 0 if closed_end else 1
    buckets = lambda s, e: F.sequence(F.floor(s / bucket_ms), F.floor((F.greatest(e, s + 1) - stretch) / bucket_ms))
    r = right.select(*[F.col(c) if c in keys else F.col(c).alias(f"r_{c}") for c in right.columns])
    lb = left.withColumn("__b", F.explode(buckets(F.col("start_ms"), F.col("end_ms"))))
    rb = r.withColumn("__b", F.explode(buckets(F.col("r_start_ms"), F.col("r_end_ms"))))
    start, end = F.greatest("start_ms", "r_start_ms"), F.least("end_ms", "r_end_ms")
    meets = (F.col("start_ms") <= F.col("r_end_ms")) if closed_end else (F.col("start_ms") < F.col("r_end_ms"))
    joined = lb.join(rb, [*keys, "__b"]).where(meets & (F.col("r_start_ms") < F.col("end_ms")) & (F.floor(start / bucket_ms) == F.col("__b")))
    return joined.drop("__b").withColumns({"overlap_start": start, "overlap_end": end, "overlap_ms": end - start})


def points_within(df: DataFrame, points: DataFrame, keys: list[str], point: str, bucket_ms: int) -> DataFrame:
    """Rows of ``df`` whose closed interval holds a point (left semi-join on buckets)."""
    names = df.columns
    rows = df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms))))
    p = points.select(*keys, F.col(point).alias("__p"), F.floor(F.col(point) / bucket_ms).alias("__b")).distinct()
    hits = rows.join(p, [*keys, "__b"]).where(F.col("__p").between(F.col("start_ms"), F.col("end_ms")))
    return hits.select(*names).distinct()


def split_long(df: DataFrame, most_ms: int) -> DataFrame:
    """Intervals cut every ``most_ms``; the last piece keeps the rest."""
    cut = F.sequence(F.col("start_ms"), F.greatest(F.col("end_ms") - 1, F.col("start_ms")), F.lit(most_ms).cast("bigint"))
    return (
        df.withColumn("__p", F.explode(cut))
        .withColumn("end_ms", F.least(F.col("end_ms"), F.col("__p") + most_ms))
        .withColumn("start_ms", F.col("__p"))
        .drop("__p")
    )


def padded_coverage(tracklets: DataFrame, keys: list[str], period_ms: int, duration: Column | int) -> DataFrame:
    """Merged coverage of an entity: each tracklet lasts one sample longer, but not beyond the duration."""
    limit = duration if isinstance(duration, Column) else F.lit(duration)
    padded = tracklets.withColumn("end_ms", F.least(limit, F.col("end_ms") + period_ms)).where("end_ms > start_ms")
    return merge_intervals(padded, keys).drop("n_merged")


def full_coverage(shots: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Shots that reach to the end of each session.

    ``sessions``: keys and duration_ms. The last shot ends with the session; a
    session without shots is one shot. Adds ``shot`` (from 1).
    """
    order = W.partitionBy(*keys).orderBy("start_ms", "end_ms")
    joined = sessions.join(shots.select(*keys, "start_ms", "end_ms"), keys, "left")
    last = F.lead("start_ms").over(order).isNull()
    whole = joined.withColumn("end_ms", F.when(last, F.col("duration_ms")).otherwise(F.col("end_ms"))).withColumn("start_ms", F.coalesce("start_ms", F.lit(0)))
    return whole.withColumn("shot", F.row_number().over(order)).select(*keys, "shot", "start_ms", "end_ms")


def elementary_states(
    speech: DataFrame, coverage: DataFrame, cuts: DataFrame, keys: list[str], occlusion_max_ms: int = 1200, tolerance_ms: int = 240,
    bucket_ms: int = 3_600_000,
) -> DataFrame:
    """Visibility states of speech intervals of a bound entity.

    ``coverage`` has merged intervals of the entity by the same keys. Clipped
    to a speech interval they are its visible pieces; between two of them lies
    a gap, which is occluded if it is at most ``occlusion_max_ms`` long and
    holds no cut (both ends included). What is left at an end of the interval
    is visible if at most ``tolerance_ms`` long. All else is offscreen.
    Returns the keys, the piece, state, reason and confidence (null where
    visible).
    """
    own = [*keys, "speech_start", "speech_end"]
    rows = speech.select(*keys, "start_ms", "end_ms").distinct().where("end_ms > start_ms")
    rows = rows.withColumns({"speech_start": F.col("start_ms"), "speech_end": F.col("end_ms")})
    seen = overlap_join(rows, coverage.select(*keys, "start_ms", "end_ms"), keys, bucket_ms)
    seen = seen.select(*own, F.col("overlap_start").alias("start_ms"), F.col("overlap_end").alias("end_ms"))
    order = W.partitionBy(*own).orderBy("start_ms")
    before = seen.select(*own, F.coalesce(F.lag("end_ms").over(order), F.col("speech_start")).alias("a"), F.col("start_ms").alias("b"), F.lag("end_ms").over(order).isNotNull().alias("inner"))
    last = seen.groupBy(*own).agg(F.max("end_ms").alias("a"))
    after = rows.select(*own).join(last, own, "left").select(*own, F.coalesce("a", "speech_start").alias("a"), F.col("speech_end").alias("b"), F.lit(False).alias("inner"))
    gaps = before.unionByName(after).where("b > a").withColumnsRenamed({"a": "start_ms", "b": "end_ms"})
    length = F.col("end_ms") - F.col("start_ms")
    short = gaps.where(F.col("inner") & (length <= occlusion_max_ms)).select(*own, "start_ms", "end_ms")
    cut = points_within(short, cuts, keys[:1], "cut_ms", bucket_ms).withColumn("cut", F.lit(True))
    gaps = gaps.join(cut, [*own, "start_ms", "end_ms"], "left")
    occluded = F.col("inner") & (length <= occlusion_max_ms) & F.col("cut").isNull()
    edge = ~F.col("inner") & (length <= tolerance_ms)
    pick = lambda visible, hidden, gone: F.when(edge, visible).when(occluded, hidden).otherwise(gone)
    none = F.lit(None).cast("double")
    # Reasons and confidences.
    missing = gaps.select(
        *keys, "start_ms", "end_ms", pick(F.lit("visible"), F.lit("occluded"), F.lit("offscreen")).alias("state"),
        pick(F.lit("timestamp_boundary_tolerance"), F.lit("short_gap_within_same_shot"), F.lit("bound_face_absent")).alias("reason"),
        pick(none, F.lit(0.65), F.lit(0.85)).alias("confidence"),
    )
    visible = seen.select(*keys, "start_ms", "end_ms", F.lit("visible").alias("state"), F.lit("face_track_present").alias("reason"), none.alias("confidence"))
    return visible.unionByName(missing)


def classify_visibility(
    speech: DataFrame, associations: DataFrame, coverage: DataFrame, cuts: DataFrame, occlusion_max_ms: int = 1200, tolerance_ms: int = 240,
) -> DataFrame:
    """Visibility of each speaker while speaking, joined where nothing changes.

    ``speech``: sid, speaker, start_ms, end_ms; ``associations``: sid, speaker,
    face_id, status, confidence; ``coverage``: sid, face_id, start_ms, end_ms.
    Without a settled association the state is unknown, without a face
    offscreen; the others have the states of their face's coverage, none more
    certain than the association.
    """
    bound = associations.select("sid", "speaker", "face_id", "status", F.col("confidence").alias("bound"))
    rows = speech.select("sid", "speaker", "start_ms", "end_ms").join(bound, ["sid", "speaker"], "left")
    unsettled = F.col("status").isNull() | F.col("status").isin("candidate", "ambiguous")
    faceless = ~unsettled & ((F.col("status") == "offscreen") | F.col("face_id").isNull())
    # States, reasons and confidences without a confirmed face.
    unknown = rows.where(unsettled).select(
        "sid", "speaker", "face_id", "start_ms", "end_ms", F.lit("unknown").alias("state"), F.lit("identity_binding_unresolved").alias("reason"), F.lit(0.9).alias("confidence"),
    )
    away = rows.where(faceless).select(
        "sid", "speaker", F.lit(None).cast("string").alias("face_id"), "start_ms", "end_ms", F.lit("offscreen").alias("state"), F.lit("no_bound_visible_face").alias("reason"),
        F.lit(0.75).alias("confidence"),
    )
    settled = rows.where(~unsettled & ~faceless)
    cover = bound.join(coverage, ["sid", "face_id"]).select("sid", "speaker", "face_id", "start_ms", "end_ms")
    states = elementary_states(settled, cover, cuts, ["sid", "speaker", "face_id"], occlusion_max_ms, tolerance_ms)
    states = states.join(bound.select("sid", "speaker", "bound"), ["sid", "speaker"]).withColumn("confidence", F.least("confidence", "bound")).drop("bound")
    return merge_states(unknown.unionByName(away).unionByName(states), ["sid"], ["speaker", "face_id", "state", "reason", "confidence"])


def merge_states(df: DataFrame, session: list[str], same: list[str], order: list[str] | None = None) -> DataFrame:
    """Join a row to the one before it in the session's order if all of ``same`` agree and it begins by that one's end.

    The order is that of the whole session, so rows of another entity between
    two rows keep them apart.
    """
    w = W.partitionBy(*session).orderBy("start_ms", "end_ms", *(order or same))
    agree: Column = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.lag(c).over(w))
    run = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(agree & (F.col("start_ms") <= F.lag("end_ms").over(w)) & run.isNotNull(), 0).otherwise(1)
    marked = df.withColumn("__f", fresh).withColumn("__g", F.sum("__f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*session, "__g", *same).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_rows")).drop("__g")


def interpolate(df: DataFrame, keys: list[str], step: int, values: list[str], at: str = "t", max_gap: int | None = None) -> DataFrame:
    """Linear interpolation of ``values`` on a grid of ``step`` from each key's first point to its last.

    Between two points more than ``max_gap`` apart only the points themselves stay.
    """
    w = W.partitionBy(*keys).orderBy(at)
    first = F.min(at).over(W.partitionBy(*keys))
    nxt = df.withColumn("__first", first).withColumn("__n", F.lead(at).over(w))
    for v in values:
        nxt = nxt.withColumn(f"__n_{v}", F.lead(v).over(w))
    off = F.col("__first") + F.ceil((F.col(at) - F.col("__first")) / step) * step
    grid = F.when(F.col("__n").isNull(), F.when(off == F.col(at), F.array(F.col(at)))).when(off < F.col("__n"), F.sequence(off, F.col("__n") - 1, F.lit(step).cast("bigint")))
    if max_gap is not None:
        grid = F.when(F.col("__n") - F.col(at) > max_gap, F.when(off == F.col(at), F.array(F.col(at)))).otherwise(grid)
    rows = nxt.withColumn("__g", F.explode(grid))
    part = (F.col("__g") - F.col(at)) / (F.col("__n") - F.col(at))
    line = lambda v: F.when(F.col("__n").isNull() | (F.col("__g") == F.col(at)), F.col(v)).otherwise(F.col(v) + (F.col(f"__n_{v}") - F.col(v)) * part)
    return rows.select(*keys, F.col("__g").alias(at), *[line(v).alias(v) for v in values])
