"""Binding speakers to faces by temporal overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip, r6
from .intervals import merge_intervals, overlap_join, union_duration

SPEAKERS = ("A", "B", "C", "D")
BUCKET_MS = 3_600_000


def evidence(speech: DataFrame, segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Union overlap of each (sid, speaker, face_id): overlap_ms."""
    merged = merge_intervals(speech, ["sid", "speaker"]).select("sid", "speaker", "start_ms", "end_ms")
    pairs = overlap_join(merged, segments.select("sid", "face_id", "start_ms", "end_ms"), ["sid"], bucket_ms)
    parts = pairs.select("sid", "speaker", F.col("r_face_id").alias("face_id"), F.col("overlap_start").alias("start_ms"), F.col("overlap_end").alias("end_ms"))
    return union_duration(parts, ["sid", "speaker", "face_id"]).withColumnRenamed("duration_ms", "overlap_ms")


def span_candidates(spans: DataFrame, segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Faces active within each span by union overlap, ranked (more overlap, then face)."""
    pairs = overlap_join(spans.select("sid", "span_id", "start_ms", "end_ms"), segments.select("sid", "face_id", "start_ms", "end_ms"), ["sid"], bucket_ms)
    parts = pairs.select("sid", "span_id", F.col("r_face_id").alias("face_id"), F.col("overlap_start").alias("start_ms"), F.col("overlap_end").alias("end_ms"))
    total = union_duration(parts, ["sid", "span_id", "face_id"]).withColumnRenamed("duration_ms", "overlap_ms")
    w = W.partitionBy("sid", "span_id").orderBy(F.desc("overlap_ms"), "face_id")
    return total.withColumn("rank", F.row_number().over(w))


def assign(overlaps: DataFrame) -> DataFrame:
    """One-to-one assignment of the (at most four) speakers of a session with the largest total overlap.

    Ties take the smallest faces in speaker order, none counting as last. A
    speaker's four best faces are enough: with any other, one of the four is
    free and does at least as well. Returns sid, speaker, face_id (null: none).
    """
    best = overlaps.where("overlap_ms > 0").withColumn(
        "n", F.row_number().over(W.partitionBy("sid", "speaker").orderBy(F.desc("overlap_ms"), "face_id"))
    ).where(F.col("n") <= len(SPEAKERS))
    pick = lambda s: F.collect_list(F.when(F.col("speaker") == s, F.struct("face_id", "overlap_ms"))).alias(s)
    none = F.array(F.struct(F.lit(None).cast("string").alias("face_id"), F.lit(0).cast("bigint").alias("overlap_ms")))
    choices = best.groupBy("sid").agg(*[pick(s) for s in SPEAKERS])
    for s in SPEAKERS:
        choices = choices.withColumn(s, F.explode(F.concat(F.col(s), none)))
    faces = F.array(*[F.col(f"{s}.face_id") for s in SPEAKERS])
    used = F.filter(faces, lambda f: f.isNotNull())
    total = reduce(lambda a, b: a + b, [F.col(f"{s}.overlap_ms") for s in SPEAKERS])
    ranked = choices.where(F.size(F.array_distinct(used)) == F.size(used)).withColumn(
        "n", F.row_number().over(W.partitionBy("sid").orderBy(total.desc(), *[F.coalesce(F.col(f"{s}.face_id"), F.lit("~")) for s in SPEAKERS]))
    )
    top = ranked.where("n = 1").select("sid", *[F.col(f"{s}.face_id").alias(s) for s in SPEAKERS])
    return top.select("sid", F.explode(F.array(*[F.struct(F.lit(s).alias("speaker"), F.col(s).alias("face_id")) for s in SPEAKERS])).alias("x")).select("sid", "x.*")


def bind(
    speech: DataFrame, segments: DataFrame, min_evidence_ms: int = 3000, min_coverage: float = 0.5, min_margin: float = 0.4, online: bool = False,
) -> DataFrame:
    """Association of each speaker of a session: face, measures, confidence and status."""
    overlaps = evidence(speech, segments)
    spoken = union_duration(speech, ["sid", "speaker"]).withColumnRenamed("duration_ms", "speech_ms")
    active = union_duration(segments, ["sid", "face_id"]).withColumnRenamed("duration_ms", "active_ms")
    chosen = assign(overlaps)
    other = (
        overlaps.join(chosen.withColumnRenamed("face_id", "own"), ["sid", "speaker"], "left")
        .groupBy("sid", "speaker")
        .agg(
            F.coalesce(F.max(F.when(F.col("own").isNull() | (F.col("face_id") != F.col("own")), F.col("overlap_ms"))), F.lit(0)).alias("runner_up_ms"),
            F.count(F.lit(1)).alias("n_candidates"),
        )
    )
    rows = (
        spoken.join(chosen, ["sid", "speaker"], "left")
        .join(overlaps, ["sid", "speaker", "face_id"], "left")
        .join(other, ["sid", "speaker"], "left")
        .join(active, ["sid", "face_id"], "left")
        .fillna({"overlap_ms": 0, "runner_up_ms": 0, "n_candidates": 0, "active_ms": 0})
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    lead = F.col("overlap_ms") - F.col("runner_up_ms")
    coverage, purity = over("overlap_ms", "speech_ms"), over("overlap_ms", "active_ms")
    margin = F.when(F.col("speech_ms") > 0, lead / F.col("speech_ms")).otherwise(F.lit(0.0))
    dominance = F.when(F.col("overlap_ms") > 0, F.greatest(F.lit(0.0), lead / F.col("overlap_ms"))).otherwise(F.lit(0.0))
    none = F.col("face_id").isNull()
    short, thin, close = F.col("overlap_ms") < min_evidence_ms, coverage < min_coverage, margin < min_margin
    if online:
        status = F.when(none, "offscreen").when(short | thin, "candidate").when(close, "ambiguous").otherwise("confirmed")
    else:
        status = (
            F.when(none & (F.col("n_candidates") > 0), "ambiguous").when(none, "offscreen").when(short, "candidate").when(close, "ambiguous")
            .when(thin, "candidate").otherwise("confirmed")
        )
    return rows.select(
        "sid", "speaker", "face_id", "overlap_ms", "speech_ms", "active_ms", "runner_up_ms", r6(coverage).alias("coverage"), r6(purity).alias("purity"),
        (F.floor(margin * 1000000 + 0.5) / F.lit(1000000.0)).alias("margin"), r6(clip(0.6 * coverage + 0.25 * purity + 0.15 * dominance)).alias("confidence"), status.alias("status"),
    )


def relabel(
    spans: DataFrame, segments: DataFrame, bindings: DataFrame, min_confidence: float = 0.7, min_overlap_ms: int = 1200, min_coverage: float = 0.6,
    min_dominance: float = 0.6,
) -> DataFrame:
    """Corrections: spans whose best face is anchored to another speaker.

    ``spans``: sid, span_id, speaker, start_ms, end_ms. Returns sid, span_id,
    original_speaker, speaker, face_id, overlap_ms, coverage and dominance.
    """
    anchors = bindings.where((F.col("status") == "confirmed") & (F.col("confidence") >= min_confidence)).select(
        "sid", "face_id", F.col("speaker").alias("anchored")
    )
    ranked = span_candidates(spans, segments)
    top = ranked.groupBy("sid", "span_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("face_id"))).alias("face_id"),
        F.max(F.when(F.col("rank") == 1, F.col("overlap_ms"))).alias("overlap_ms"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("overlap_ms"))), F.lit(0)).alias("second_ms"),
    )
    rows = spans.join(top, ["sid", "span_id"]).join(anchors, ["sid", "face_id"])
    coverage = F.col("overlap_ms") / (F.col("end_ms") - F.col("start_ms"))
    dominance = (F.col("overlap_ms") - F.col("second_ms")) / F.col("overlap_ms")
    keep = (F.col("anchored") != F.col("speaker")) & (F.col("overlap_ms") >= min_overlap_ms) & (coverage >= min_coverage) & (dominance >= min_dominance)
    return rows.where(keep).select(
        "sid", "span_id", F.col("speaker").alias("original_speaker"), F.col("anchored").alias("speaker"), "face_id", "overlap_ms",
        r6(coverage).alias("coverage"), r6(dominance).alias("dominance"),
    )


def reconcile(spans: DataFrame, segments: DataFrame, max_passes: int = 4, **thresholds) -> tuple[DataFrame, int, bool]:
    """Relabel and bind again until the corrections repeat: corrected spans, passes, whether they became stable.

    The spans of each pass are written to the shared folder. Corrections are
    compared by a count and an order-free hash sum, not collected.
    """
    from ..sources.documents import checkpointed

    seen, current = None, spans
    for n in range(1, max_passes + 1):
        bindings = bind(current, segments, **thresholds)
        fixes = relabel(spans, segments, bindings).select("sid", "span_id", F.col("speaker").alias("fixed"))
        merged = spans.join(fixes, ["sid", "span_id"], "left").withColumn("original_speaker", F.when(F.col("fixed").isNotNull(), F.col("speaker")))
        current = checkpointed(merged.withColumn("speaker", F.coalesce("fixed", "speaker")).drop("fixed"), "reconcile")
        mark = current.where(F.col("original_speaker").isNotNull()).agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("sid", "span_id", "speaker").cast("decimal(38,0)"))
        ).first()
        if mark == seen:
            return current, n, True
        seen = mark
    return current, max_passes, False


def evidence_hash(overlaps: DataFrame) -> DataFrame:
    """A hash of each session's evidence that doesn't depend on the order of rows or on any binding.

    ``overlaps``: sid, speaker, face_id, overlap_ms. It is the SHA-256 of a JSON
    array of objects with sorted keys, in order of speaker and face.
    """
    rows = F.array_sort(F.collect_list(F.struct("speaker", "face_id", "overlap_ms")))
    content = F.to_json(F.transform(rows, lambda x: F.struct(x["face_id"].alias("face_id"), x["overlap_ms"].alias("overlap_ms"), x["speaker"].alias("speaker"))))
    return overlaps.groupBy("sid").agg(content.alias("content")).select("sid", F.sha2("content", 256).alias("evidence_sha256"))
