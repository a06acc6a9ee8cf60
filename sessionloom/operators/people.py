"""Participants, faces and the evidence that links them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..functions.text import SPACES, content_id
from .intervals import overlap_join


def person_nodes(faces: DataFrame, bindings: DataFrame, participants: DataFrame) -> DataFrame:
    """A node for each face, and for each participant whom no face was confirmed for.

    ``faces``: sid, face_id; ``bindings``: sid, speaker, face_id, status,
    confidence; ``participants``: sid, speaker, display_name. A face with a
    confirmed speaker is that person, another an identity of its own. Returns
    sid, id, type, label, face_id, speaker, identity_status, confidence.
    """
    sure = bindings.where("status = 'confirmed' AND face_id IS NOT NULL").select("sid", "speaker", "face_id", "confidence")
    named = participants.select("sid", "speaker", "display_name")
    known = faces.join(sure, ["sid", "face_id"], "left").join(named, ["sid", "speaker"], "left")
    bound = F.col("speaker").isNotNull()
    seen = known.select(
        "sid", F.when(bound, F.concat(F.lit("person:speaker:"), "speaker")).otherwise(F.concat(F.lit("visual_identity:"), "face_id")).alias("id"),
        F.when(bound, "person").otherwise("visual_identity").alias("type"), F.coalesce("display_name", "speaker", "face_id").alias("label"),
        "face_id", "speaker", F.when(bound, "confirmed").otherwise("unconfirmed").alias("identity_status"), "confidence",
    )
    unseen = named.join(known.where(bound).select("sid", "speaker"), ["sid", "speaker"], "left_anti").select(
        "sid", F.concat(F.lit("person:speaker:"), "speaker").alias("id"), F.lit("person").alias("type"), F.coalesce("display_name", "speaker").alias("label"),
        F.lit(None).cast("string").alias("face_id"), "speaker", F.lit("unbound").alias("identity_status"), F.lit(None).cast("double").alias("confidence"),
    )
    return seen.unionByName(unseen)


def associations(candidates: DataFrame, bindings: DataFrame, min_evidence_ms: int = 1000) -> DataFrame:
    """Links of participants and faces, with their state.

    ``candidates``: sid, speaker, face_id, overlap_ms, coverage. A speaker's
    bound face is always linked, others from ``min_evidence_ms`` on. The bound
    face of a confirmed binding is confirmed, any face of an ambiguous one
    disputed, all others are candidates.
    """
    own = bindings.select("sid", "speaker", F.col("face_id").alias("bound"), "status", F.col("confidence").alias("bound_confidence"))
    primary = F.col("bound").eqNullSafe(F.col("face_id"))
    rows = candidates.join(own, ["sid", "speaker"]).where(primary | (F.col("overlap_ms") >= min_evidence_ms))
    state = F.when(primary & (F.col("status") == "confirmed"), "confirmed").when(F.col("status") == "ambiguous", "disputed").otherwise("candidate")
    return rows.select(
        "sid", F.concat_ws(":", F.lit("association:speaker-face"), "speaker", "face_id").alias("id"), "speaker", "face_id", "overlap_ms", state.alias("state"),
        r6(F.when(primary, F.col("bound_confidence")).otherwise(F.col("coverage"))).alias("confidence"),
    )


def evidence_records(speech: DataFrame, segments: DataFrame, bindings: DataFrame, bucket_ms: int) -> DataFrame:
    """Content-addressed rows for each overlap of a speaker's spans with a face's activity.

    The id hashes participant, face, segment and time; the payload is JSON with
    sorted keys. Overlaps that say the same are one row, with the spans that
    they come from in order.
    """
    pairs = overlap_join(speech.select("sid", "span_id", "speaker", "start_ms", "end_ms"), segments.select("sid", "segment_id", "face_id", "start_ms", "end_ms"), ["sid"], bucket_ms)
    status = bindings.select("sid", "speaker", "status")
    named = pairs.join(status, ["sid", "speaker"]).select(
        "sid", "speaker", "span_id", F.col("r_face_id").alias("face_id"), F.col("r_segment_id").cast("string").alias("segment_id"), "status",
        F.col("overlap_start").alias("start_ms"), F.col("overlap_end").alias("end_ms"), F.col("overlap_ms").alias("duration_ms"),
    )
    once = named.groupBy("sid", "speaker", "face_id", "segment_id", "status", "start_ms", "end_ms", "duration_ms").agg(F.sort_array(F.collect_set("span_id")).alias("span_ids"))
    payload = F.to_json(
        F.struct(
            F.col("segment_id").alias("active_speaker_segment_id"), F.col("status").alias("binding_status"), "duration_ms", "end_ms", F.col("speaker").alias("speaker_label"),
            "start_ms", F.lit("speaker_face_temporal_overlap").alias("type"), F.col("face_id").alias("visual_entity_ref"),
        )
    )
    key = content_id("", F.concat(F.lit("participant:"), F.col("speaker")), F.col("face_id"), F.col("segment_id"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string"))
    found = once.withColumns({"id": F.concat(F.col("sid").cast("string"), F.lit(":evidence:multimodal:"), key), "content": payload})
    return found.select("sid", "id", "speaker", "face_id", "segment_id", "start_ms", "end_ms", "span_ids", "content", F.sha2("content", 256).alias("content_sha256"))


def one_payload(records: DataFrame) -> DataFrame:
    """One row for each id; raises where rows of an id differ in content."""
    w = W.partitionBy("sid", "id").orderBy("content")
    same = F.first("content").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == F.last("content").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    checked = F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("evidence id collision: "), "id")).cast("string"))
    return records.withColumn("content", checked).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def identity_candidates(links: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from a speaker to the person or identity of each face disputed with them, over the time of the evidence."""
    times = evidence.groupBy("sid", "speaker", "face_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_evidence"))
    target = nodes.where("face_id IS NOT NULL").select("sid", "face_id", F.col("id").alias("target"))
    return links.where("state = 'disputed'").join(times, ["sid", "speaker", "face_id"], "left").join(target, ["sid", "face_id"]).select(
        "sid", F.concat(F.lit("person:speaker:"), "speaker").alias("source"), "target", "confidence", F.coalesce("start_ms", F.lit(0)).alias("start_ms"),
        F.coalesce("end_ms", "start_ms", F.lit(0)).alias("end_ms"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
    )


def quality(score: Column, w: Column, h: Column, variance: Column) -> Column:
    """Quality of a detection from its score, size and sharpness (variance of the Laplacian)."""
    scale, sharp = F.least(F.lit(1.0), F.sqrt(w * h) / 112.0), F.least(F.lit(1.0), variance / 180.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * (0.45 + 0.30 * scale + 0.25 * sharp)))


def verified_evidence(evidence: DataFrame, spans: DataFrame, bucket_ms: int, tolerance_ms: int = 250) -> DataFrame:
    """Whether a speaker's spans say what the evidence does, and when.

    ``evidence``: sid, evidence_id, speaker, start_ms, end_ms, text; ``spans``:
    sid, span_id, speaker, start_ms, end_ms, text. The texts of the overlapping
    spans, joined in order, must hold the evidence's, white space apart, and
    cover its time but for ``tolerance_ms`` at each end. Returns sid,
    evidence_id, verified (false without spans).
    """
    pairs = overlap_join(evidence, spans.select("sid", "span_id", "speaker", "start_ms", "end_ms", "text"), ["sid", "speaker"], bucket_ms)
    own = ["sid", "speaker", "evidence_id"]
    said = pairs.groupBy(*own).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r_start_ms", "r_span_id", "r_text"))), lambda x: x["r_text"]).alias("parts"),
        F.min("r_start_ms").alias("first"), F.max("r_end_ms").alias("last"),
    )
    bare = lambda c: F.regexp_replace(c, SPACES, "")
    rows = evidence.join(said, own, "left")
    covers = (F.col("first") <= F.col("start_ms") + tolerance_ms) & (F.col("last") >= F.col("end_ms") - tolerance_ms)
    holds = F.contains(bare(F.array_join("parts", "")), bare(F.col("text")))
    return rows.select("sid", "evidence_id", F.coalesce(covers & holds, F.lit(False)).alias("verified"))
