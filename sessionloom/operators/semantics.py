"""Normalisation of keyframe analyses: environments, objects and interactions.

An analysis has category, description, confidence, objects (array of label and
confidence) and interactions (array of subject, predicate, object).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..functions.text import canonical_label, let, strip

# Words that tell a stage or a home from an office, labels of graphics, predicates of speech.
STAGE_WORDS = ("演讲舞台", "舞台", "stage")
HOME_WORDS = ("起居室", "客厅", "住宅", "卧室", "living room", "residential", "home interior")
GRAPHIC_LABELS = ("logo", "title", "title card", "graphic")
OVERLAY_LABELS = ("subtitle", "text")
SPEECH_PREDICATES = ("speaking", "listening")
GRAPHIC_TEXT = "Graphic or title card with a visible logo or title."


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def repair_environment(df: DataFrame) -> DataFrame:
    """``df`` with the category corrected where the description or the objects tell another."""
    text = F.lower(F.coalesce("description", F.lit("")))
    office = F.col("category") == "indoor_office"
    category = F.when(office & _has_any(text, STAGE_WORDS), "stage").when(office & _has_any(text, HOME_WORDS), "indoor_home").otherwise(F.col("category"))
    labels = F.transform("objects", lambda o: F.lower(strip(o["label"])))
    graphic = (F.coalesce("confidence", F.lit(0.0)) <= 0.2) & F.arrays_overlap(labels, F.array(*map(F.lit, GRAPHIC_LABELS)))
    return df.withColumns({
        "category": F.when(graphic, "graphic_or_title").otherwise(category), "description": F.when(graphic, GRAPHIC_TEXT).otherwise(F.col("description")),
        "confidence": F.when(graphic, 0.6).otherwise(F.col("confidence")),
    })


def scene_objects(df: DataFrame) -> DataFrame:
    """``df`` (repaired) without overlays, a logo only in graphic frames; labels by their canonical name."""

    def keep(x: Column) -> Column:
        return ~x["l"].isin(*OVERLAY_LABELS) & ((x["l"] != "logo") | x["g"])

    # A lambda's parts are computed wherever they stand, so the label is worked out once for an object and the category once for a row.
    marked = let(F.col("category") == "graphic_or_title", lambda g: F.transform("objects", lambda o: F.struct(o.alias("o"), F.lower(strip(o["label"])).alias("l"), g.alias("g"))))
    cleaned = F.transform(F.filter(marked, keep), lambda x: F.struct(canonical_label(x["o"]["label"]).alias("label"), x["o"]["confidence"].alias("confidence")))
    return df.withColumn("objects", cleaned)


def object_labels(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each object that ``scene_objects`` keeps: ``keys`` and its canonical label.

    Rows run through compiled code and each label is worked out once, which
    takes a third of the time of lambdas. An inner explode would make the
    optimizer ask for the size of the array first, which computes it again.
    """
    graphic = F.col("category") == "graphic_or_title"
    rows = df.select(*keys, graphic.alias("__g"), F.explode_outer("objects").alias("__o")).where("__o IS NOT NULL")
    label = F.lower(strip(F.col("__o.label")))
    kept = rows.where(~label.isin("logo", *OVERLAY_LABELS) | ((label == "logo") & F.col("__g")))
    return kept.select(*keys, canonical_label(F.col("__o.label")).alias("label"))


def group_speech_only(df: DataFrame) -> DataFrame:
    """``df`` without speaking and listening to anyone but the group."""
    return df.withColumn("interactions", F.filter("interactions", lambda x: ~x["predicate"].isin(*SPEECH_PREDICATES) | x["object"].isNull() | (x["object"] == "group")))


def visible_interactions(df: DataFrame, faces: str) -> DataFrame:
    """``df`` with the interactions of visible subjects, without speech, with valid targets only (live form)."""

    def keep(x: Column) -> Column:
        target, face = F.coalesce(x["object"], F.lit("")), x["object"].startswith("Face-")
        valid = (target == "") | F.when(face, F.array_contains(faces, x["object"])).otherwise(target.startswith("object:") | target.isin("group", "scene"))
        return F.array_contains(faces, x["subject"]) & ~x["predicate"].isin(*SPEECH_PREDICATES) & valid

    return df.withColumn("interactions", F.filter("interactions", keep))


def transcript_interactions(transcript: DataFrame, visible: DataFrame) -> DataFrame:
    """A visible speaker of a shot speaks to the group, once, in order of the first span.

    ``transcript``: sid, scene_id, speaker, start_ms; ``visible``: sid,
    scene_id, speaker, face_id. Returns sid, scene_id, n, subject, predicate,
    object, confidence.
    """
    from pyspark.sql import Window as W

    first = transcript.groupBy("sid", "scene_id", "speaker").agg(F.min("start_ms").alias("start_ms"))
    rows = first.join(visible.where("face_id IS NOT NULL"), ["sid", "scene_id", "speaker"])
    n = F.row_number().over(W.partitionBy("sid", "scene_id").orderBy("start_ms", "speaker"))
    return rows.select("sid", "scene_id", n.alias("n"), F.col("face_id").alias("subject"), F.lit("speaking").alias("predicate"), F.lit("group").alias("object"), F.lit(0.9).alias("confidence"))


def reuse_analyses(plan: DataFrame, analyses: DataFrame, spoken: DataFrame) -> DataFrame:
    """Analyses of all keyframes of a plan, copied from their source with confidences times similarity.

    ``plan``: sid, keyframe_id, source_id, similarity; ``spoken``: sid,
    keyframe_id, interactions. A copy has no interactions of its source. Those
    of the transcript are added unless one of the same subject, predicate and
    object is there. Keyframes whose source was not analysed are left out.
    """
    own = F.col("keyframe_id") == F.col("source_id")
    rows = plan.join(analyses.withColumnRenamed("keyframe_id", "source_id"), ["sid", "source_id"]).join(spoken.withColumnRenamed("interactions", "said"), ["sid", "keyframe_id"], "left")
    scaled = lambda c: F.when(own, c).otherwise(r6(c * F.col("similarity")))
    kept = F.when(own, F.col("interactions")).otherwise(F.slice("interactions", 1, 0))
    return rows.select(
        "sid", "keyframe_id", "source_id", "similarity", F.when(own, "model").otherwise("visual_reuse").alias("semantic_source"), "category", "description",
        scaled(F.col("confidence")).alias("confidence"),
        F.transform("objects", lambda o: F.struct(o["label"].alias("label"), scaled(o["confidence"]).alias("confidence"))).alias("objects"),
        F.concat(kept, F.coalesce(F.filter("said", lambda s: ~F.exists(kept, lambda x: x.eqNullSafe(s))), F.slice(kept, 1, 0))).alias("interactions"),
    )


def request_hash(*parts: Column) -> Column:
    """Identity of a request to a model: the SHA-256 of version, model name, metadata as JSON and image hashes, end to end."""
    return F.sha2(F.concat(*parts), 256)


def pending(requests: DataFrame, memo: DataFrame) -> DataFrame:
    """Requests whose hash no earlier answer has; equal ones are asked once. Both have ``request_sha256``."""
    return requests.dropDuplicates(["request_sha256"]).join(memo.select("request_sha256"), "request_sha256", "left_anti")
