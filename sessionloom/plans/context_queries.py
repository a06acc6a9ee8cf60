"""Participant, dialogue, semantics and activity-record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import activity, binding, dialogue, evaluation, intervals, people, semantics
from ..sources.documents import checkpointed
from . import adapter as A
from .adapter import sql
from .interval_queries import _BIND, _OFFLINE, HOUR, total

SPEAKERS = ("A", "B", "C", "D")


def _bound(spark, d) -> DataFrame:
    """Associations, written once: at most four for each session."""
    return checkpointed(binding.bind(A.speech(spark, d), A.active(spark, d), min_coverage=0.1, min_margin=0.01), "bindings")


def _participants(spark, d) -> DataFrame:
    sessions = A.timed_events(spark, d).select("sid").distinct()
    who = sessions.withColumn("speaker", F.explode(F.array(*map(F.lit, SPEAKERS))))
    return who.withColumn("display_name", F.when(F.col("speaker") == "A", F.lit("Ann")))


def _faces(spark, d) -> DataFrame:
    return A.active(spark, d).select("sid", "face_id").distinct()


def person_nodes(spark, d) -> DataFrame:
    return people.person_nodes(_faces(spark, d), _bound(spark, d), _participants(spark, d))


def _links(spark, d, bound) -> DataFrame:
    spoken = intervals.union_duration(A.speech(spark, d), ["sid", "speaker"])
    seen = binding.evidence(A.speech(spark, d), A.active(spark, d)).join(spoken, ["sid", "speaker"])
    return people.associations(seen.withColumn("coverage", F.col("overlap_ms") / F.col("duration_ms")), bound, 600_000)


def participant_associations(spark, d) -> DataFrame:
    return _links(spark, d, _bound(spark, d))


def evidence_records(spark, d) -> DataFrame:
    found = people.one_payload(people.evidence_records(A.speech(spark, d), A.active(spark, d), _bound(spark, d), HOUR))
    return found.withColumn("span_ids", F.array_join(F.col("span_ids").cast("array<string>"), ","))


def identity_candidates(spark, d) -> DataFrame:
    bound = _bound(spark, d)
    evidence = people.evidence_records(A.speech(spark, d), A.active(spark, d), bound, HOUR)
    return people.identity_candidates(_links(spark, d, bound), evidence, people.person_nodes(_faces(spark, d), bound, _participants(spark, d)))


def face_summaries(spark, d) -> DataFrame:
    a = A.active(spark, d)
    length = intervals.union_duration(a, ["sid", "face_id"], pad_ms=200).withColumnRenamed("duration_ms", "visible_ms")
    rows = a.groupBy("sid", "face_id").agg(
        F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"), r6(F.avg("score_u")).alias("mean_score"),
        F.max_by("segment_id", F.struct(F.col("score_u"), -F.col("segment_id"))).alias("representative"),
    )
    return rows.join(length, ["sid", "face_id"])


def detection_quality(spark, d) -> DataFrame:
    q = people.quality(F.col("confidence"), F.col("w") * 640, F.col("h") * 360, F.col("sharpness") / 1000.0)
    return A.boxes(spark, d).select("keyframe_id", "state", r6(q).alias("quality"))


def _dialogue(spark, d) -> tuple[DataFrame, DataFrame]:
    t = A.turns(spark, d)
    long = F.filter(F.split(F.lower("text"), " "), lambda x: F.char_length(x) >= 9)
    turns = t.select("sid", "turn_id", "speaker", "start_ms", "end_ms", long.alias("topics"), F.get(F.split("text", " "), F.lit(0)).alias("intent"))
    asked = F.sort_array(F.collect_list(F.when(F.contains("text", F.lit("?")), F.col("turn_id"))))
    scene = t.groupBy("sid", "speaker").agg(asked.alias("turn_ids"))
    n = F.row_number().over(W.partitionBy("sid").orderBy("speaker"))
    return turns, scene.select("sid", n.alias("n"), F.concat(F.lit("topic "), "speaker").alias("name"), "turn_ids")


def _spelled(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})


def turn_topics(spark, d) -> DataFrame:
    return dialogue.turn_topics(*_dialogue(spark, d)).drop("pos")


def topic_catalog(spark, d) -> DataFrame:
    return _spelled(dialogue.topic_catalog(*_dialogue(spark, d)), "turn_ids")


def intent_nodes(spark, d) -> DataFrame:
    return _spelled(dialogue.intents(_dialogue(spark, d)[0]), "turn_ids", "speakers")


def dialogue_edges(spark, d) -> DataFrame:
    return dialogue.dialogue_edges(*_dialogue(spark, d))


def _semantics(spark, d) -> DataFrame:
    """Analyses: each document is a keyframe, its words and one label by its number the objects."""
    labels = F.array(*[F.lit(x) for x in ("logo", "subtitle", "mic", "Potted-Plant", "text")])
    words = F.concat(F.split("text", " "), F.array(F.element_at(labels, (F.col("doc_id") % 5 + 1).cast("int"))))
    face = lambda n: F.concat(F.lit("Face-0"), (F.col("doc_id") % n + 1).cast("string"))
    act = lambda predicate, target: F.struct(face(4).alias("subject"), F.lit(predicate).alias("predicate"), target.cast("string").alias("object"))
    interactions = F.array(
        act("speaking", F.lit(None)), act("listening", F.lit("group")), act("speaking", face(3)), act("looking_at", face(3)), act("holding", F.lit("object:cup")), act("using", F.lit("cup"))
    )
    return A.table(spark, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.when(F.col("lang") == "en", "indoor_office").otherwise(F.col("lang")).alias("category"), F.col("text").alias("description"),
        ((F.col("doc_id") % 10) / 10.0).cast("double").alias("confidence"), F.transform(words, lambda w: F.struct(w.alias("label"), F.lit(0.5).alias("confidence"))).alias("objects"),
        interactions.alias("interactions"), F.array(F.lit("Face-01"), F.lit("Face-02"), F.lit("Face-03")).alias("faces"),
    )


def environment_repair(spark, d) -> DataFrame:
    return semantics.repair_environment(_semantics(spark, d)).select("doc_id", "category", F.sha2("description", 256).alias("description_sha256"), "confidence")


def canonical_objects(spark, d) -> DataFrame:
    rows = semantics.object_labels(semantics.repair_environment(_semantics(spark, d)), ["doc_id"])
    return rows.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


def _interactions(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode("interactions").alias("x")).select("doc_id", "x.*")


def offline_interactions(spark, d) -> DataFrame:
    return _interactions(semantics.group_speech_only(_semantics(spark, d)))


def live_interactions(spark, d) -> DataFrame:
    return _interactions(semantics.visible_interactions(_semantics(spark, d), "faces"))


def transcript_interactions(spark, d) -> DataFrame:
    pairs = intervals.overlap_join(A.scenes(spark, d), A.turns(spark, d), ["sid"], 4000)
    said = pairs.select("sid", "scene_id", F.col("r_speaker").alias("speaker"), F.col("r_start_ms").alias("start_ms"))
    seen = A.scenes(spark, d).select("sid", "scene_id", F.lit("assistant").alias("speaker"), F.concat(F.lit("Face-0"), (F.col("sid") % 4 + 1).cast("string")).alias("face_id"))
    return semantics.transcript_interactions(said, seen)


def reused_analyses(spark, d) -> DataFrame:
    """A document's analysis stands for the three after it, too."""
    rows = _semantics(spark, d).withColumnsRenamed({"doc_id": "keyframe_id"}).withColumn("sid", F.lit(1)).drop("faces")
    plan = rows.select("sid", "keyframe_id", F.expr("keyframe_id div 4 * 4").alias("source_id"), (1 - (F.col("keyframe_id") % 4) / 10.0).cast("double").alias("similarity"))
    said = rows.select("sid", "keyframe_id", F.slice("interactions", 2, 2).alias("interactions"))
    found = semantics.reuse_analyses(plan, rows, said)
    return found.select("keyframe_id", "source_id", "semantic_source", "category", "confidence", F.size("objects").alias("n_objects"), r6(F.element_at("objects", -1)["confidence"]).alias("object_confidence"), F.size("interactions").alias("n_interactions"))


def environment_accuracy(spark, d) -> DataFrame:
    found = semantics.repair_environment(_semantics(spark, d)).select("doc_id", F.col("category").alias("predicted"))
    expected = A.table(spark, d, "documents").select("doc_id", "source", F.when(F.col("n_chars") > 100, F.when(F.col("lang") == "en", "indoor_office").otherwise(F.col("lang"))).alias("expected"))
    return evaluation.accuracy(expected.join(found, "doc_id", "left"), "expected", "predicted", ["source"])


def _samples(spark, d) -> DataFrame:
    return A.active(spark, d).withColumn("t", F.expr("start_ms div 60000 * 40"))


def score_records(spark, d) -> DataFrame:
    return activity.score_records(_samples(spark, d).select("sid", "t", "face_id", "segment_id"), ["sid"], ["t", "face_id", "segment_id"])


def observation_runs(spark, d) -> DataFrame:
    return activity.observation_runs(_samples(spark, d).select("sid", "face_id", "t").distinct(), ["sid", "face_id"], "t", gap_ms=2400)


def segment_records(spark, d) -> DataFrame:
    rows = _samples(spark, d).where("score_u >= 1000").withColumns({"raw": F.col("score_u") - 5000, "tracklet": F.col("segment_id") % 7})
    return _spelled(activity.segment_records(rows, ["sid", "face_id"], "t", 7200, "score_u", "raw", "tracklet"), "tracklets")


def ensemble_scores(spark, d) -> DataFrame:
    b = A.boxes(spark, d).withColumn("z", F.when(F.col("w") > 0.25, F.col("w")))
    return activity.ensemble_mean(b, ["keyframe_id", "state"], ["x", "y", "z"])


def median_smoothing(spark, d) -> DataFrame:
    return activity.median_smooth(A.active(spark, d), ["sid", "face_id"], ["start_ms", "segment_id"], "score_u").select("segment_id", "smooth")


def evidence_hash(spark, d) -> DataFrame:
    return binding.evidence_hash(binding.evidence(A.speech(spark, d), A.active(spark, d)))


def scene_extent(spark, d) -> DataFrame:
    """Extent of a session's scenes, and how many of its turns lie in none for a second or more."""
    s, t = A.scenes(spark, d), A.turns(spark, d)
    linked = intervals.overlap_join(t, s, ["sid"], 4000).where("overlap_ms >= 1000").select("sid", "turn_id").distinct()
    alone = t.join(linked, ["sid", "turn_id"], "left_anti").groupBy("sid").agg(F.count(F.lit(1)).alias("unlinked"))
    extent = s.groupBy("sid").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("scenes"))
    return extent.join(alone, "sid", "left").fillna({"unlinked": 0})


def pending_requests(spark, d) -> DataFrame:
    """Keyframes are documents; those of one source have been answered already."""
    docs = A.table(spark, d, "documents").where("text IS NOT NULL")
    asked = docs.select("lang", "source", semantics.request_hash(F.lit("v1"), F.lit("model"), F.col("lang"), F.sha2("text", 256)).alias("request_sha256"))
    first = docs.agg(F.min("source").alias("source"))
    memo = asked.join(F.broadcast(first), "source").select("request_sha256")
    return semantics.pending(asked.select("lang", "request_sha256"), memo)


def verified_evidence(spark, d) -> DataFrame:
    """The turn before is the evidence, said by the speaker of the turn; so few are verified."""
    t = A.turns(spark, d)
    w = W.partitionBy("sid").orderBy("turn_id")
    claims = t.select("sid", F.col("turn_id").alias("evidence_id"), "speaker", "start_ms", "end_ms", F.when(F.char_length("text") > 200, F.col("text")).otherwise(F.coalesce(F.lag("text").over(w), "text")).alias("text"))
    return people.verified_evidence(claims, t.withColumnRenamed("turn_id", "span_id"), 4000)


def chained_segments(spark, d) -> DataFrame:
    rows = A.active(spark, d).withColumns({"n": F.struct("start_ms", "segment_id"), "score": F.col("score_u")})
    return activity.chained_segments(rows, ["sid"], ["face_id"], 600_000)


def consistency_violations(spark, d) -> DataFrame:
    """Claims against what can be counted: lines of an order, one event at a time, one face for each speaker."""
    lines, events = A.table(spark, d, "lineitem"), A.table(spark, d, "events")
    claimed = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("bigint").alias("claimed"))
    counted = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("counted"))
    return evaluation.violations(
        evaluation.mismatched(claimed, counted, ["l_orderkey"], "claimed", "counted", "line_count"),
        evaluation.not_unique(events, ["user_id", "event_type"], "one_event"),
        evaluation.not_unique(_bound(spark, d).where("face_id IS NOT NULL"), ["sid", "face_id"], "one_speaker"),
    )


_BOUND = f"{_BIND.format(status=_OFFLINE)}"
_PEOPLE = f"""{_BOUND},
who AS (SELECT *, CASE speaker WHEN 'A' THEN 'Ann' END AS display_name FROM (SELECT DISTINCT sid FROM timed) CROSS JOIN (SELECT unnest(['A', 'B', 'C', 'D']) AS speaker)),
known AS (SELECT f.sid, f.face_id, b.speaker, b.confidence, w.display_name FROM (SELECT DISTINCT sid, face_id FROM active) f
  LEFT JOIN bound b ON b.sid = f.sid AND b.face_id = f.face_id AND b.status = 'confirmed' LEFT JOIN who w ON w.sid = b.sid AND w.speaker = b.speaker),
people AS (SELECT sid, CASE WHEN speaker IS NOT NULL THEN 'person:speaker:' || speaker ELSE 'visual_identity:' || face_id END AS id, CASE WHEN speaker IS NOT NULL THEN 'person' ELSE 'visual_identity' END AS type,
  coalesce(display_name, speaker, face_id) AS label, face_id, speaker, CASE WHEN speaker IS NOT NULL THEN 'confirmed' ELSE 'unconfirmed' END AS identity_status, confidence FROM known
  UNION ALL SELECT sid, 'person:speaker:' || speaker, 'person', coalesce(display_name, speaker), NULL, speaker, 'unbound', NULL FROM who WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.sid = who.sid AND k.speaker = who.speaker)),
assoc AS (SELECT e.sid, 'association:speaker-face:' || e.speaker || ':' || e.face_id AS id, e.speaker, e.face_id, e.overlap_ms,
  CASE WHEN b.face_id = e.face_id AND b.status = 'confirmed' THEN 'confirmed' WHEN b.status = 'ambiguous' THEN 'disputed' ELSE 'candidate' END AS state,
  floor((CASE WHEN b.face_id = e.face_id THEN b.confidence ELSE e.overlap_ms / s.speech_ms END) * 1000000 + 0.5) / 1000000.0 AS confidence
  FROM ev e JOIN spoken s ON s.sid = e.sid AND s.speaker = e.speaker JOIN bound b ON b.sid = e.sid AND b.speaker = e.speaker WHERE coalesce(b.face_id = e.face_id, false) OR e.overlap_ms >= 600000),
pairs AS (SELECT DISTINCT s.sid, s.speaker, s.span_id, a.face_id, a.segment_id::VARCHAR AS segment_id, b.status, greatest(s.start_ms, a.start_ms) AS start_ms, least(s.end_ms, a.end_ms) AS end_ms
  FROM speech s JOIN active a ON s.sid = a.sid AND s.start_ms < a.end_ms AND a.start_ms < s.end_ms JOIN bound b ON b.sid = s.sid AND b.speaker = s.speaker),
rec AS (SELECT sid, speaker, face_id, segment_id, start_ms, end_ms, string_agg(span_id::VARCHAR, ',' ORDER BY span_id) AS span_ids,
  sid::VARCHAR || ':evidence:multimodal:' || substring(sha256('participant:' || speaker || chr(31) || face_id || chr(31) || segment_id || chr(31) || start_ms::VARCHAR || chr(31) || end_ms::VARCHAR), 1, 16) AS id,
  '{{"active_speaker_segment_id":"' || segment_id || '","binding_status":"' || status || '","duration_ms":' || (end_ms - start_ms)::VARCHAR || ',"end_ms":' || end_ms::VARCHAR || ',"speaker_label":"' || speaker || '","start_ms":'
  || start_ms::VARCHAR || ',"type":"speaker_face_temporal_overlap","visual_entity_ref":"' || face_id || '"}}' AS content FROM pairs GROUP BY sid, speaker, face_id, segment_id, status, start_ms, end_ms)"""
_TALK = """t AS (SELECT *, list_transform(list_filter(string_split(lower(text), ' '), lambda x: length(x) >= 9), lambda x: {strip:x}) AS own, {strip:i} AS intent FROM turns),
sc AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY speaker) AS n, 'topic ' || speaker AS name, coalesce(list(turn_id ORDER BY turn_id) FILTER (WHERE contains(text, '?')), []) AS turn_ids FROM turns GROUP BY sid, speaker),
se AS (SELECT sid, n, name, unnest(turn_ids) AS turn_id, unnest(range(0, len(turn_ids))) AS pos FROM sc),
th AS (SELECT sid, turn_id, list(name ORDER BY n) AS theirs FROM se GROUP BY sid, turn_id),
tn AS (SELECT t.sid, t.turn_id, CASE WHEN len(own) > 0 THEN own ELSE coalesce(theirs, ['未归类话题']) END AS names FROM t LEFT JOIN th ON th.sid = t.sid AND th.turn_id = t.turn_id),
tt AS (SELECT sid, turn_id, unnest(names) AS name, unnest(range(0, len(names))) AS pos FROM tn),
men AS (SELECT sid, name, 0 AS phase, n, pos, turn_id FROM se UNION ALL SELECT sid, name, 0, n, 0, NULL FROM sc WHERE len(turn_ids) = 0 UNION ALL SELECT sid, name, 1, turn_id, pos, turn_id FROM tt),
cat AS (SELECT sid, name, min((phase, n, pos)) AS f, coalesce(string_agg(turn_id::VARCHAR, ',' ORDER BY m), '') AS turn_ids FROM (SELECT sid, name, turn_id, min((phase, n, pos)) AS m, min(phase) AS phase, min(n) AS n, min(pos) AS pos FROM men GROUP BY sid, name, turn_id) GROUP BY sid, name),
f AS (SELECT sid, name, min((phase, n, pos)) AS f FROM men GROUP BY sid, name),
topic AS (SELECT f.sid, printf('topic:%04d', row_number() OVER (PARTITION BY f.sid ORDER BY f.f)) AS id, f.name, cat.turn_ids FROM f JOIN cat ON cat.sid = f.sid AND cat.name = f.name),
its AS (SELECT sid, name, printf('intent:%04d', row_number() OVER (PARTITION BY sid ORDER BY f)) AS id, start_ms, end_ms, turn_ids FROM (
  SELECT sid, intent AS name, min(turn_id) AS f, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(turn_id::VARCHAR, ',' ORDER BY turn_id) AS turn_ids FROM t WHERE intent <> '' GROUP BY sid, intent))"""
_SEM = """sem AS (SELECT doc_id, source, lang, text, CASE WHEN lang = 'en' THEN 'indoor_office' ELSE lang END AS cat0, (doc_id % 10) / 10.0::DOUBLE AS conf0, n_chars,
  list_append(string_split(text, ' '), ['logo', 'subtitle', 'mic', 'Potted-Plant', 'text'][doc_id % 5 + 1]) AS labels FROM documents WHERE text IS NOT NULL),
low AS (SELECT *, conf0 <= 0.2::DOUBLE AND list_has_any(list_transform(labels, lambda x: lower(x)), ['logo', 'title', 'title card', 'graphic']) AS g FROM sem),
rep AS (SELECT *, CASE WHEN g THEN 'graphic_or_title' WHEN cat0 = 'indoor_office' AND regexp_matches(lower(text), '演讲舞台|舞台|stage') THEN 'stage'
  WHEN cat0 = 'indoor_office' AND regexp_matches(lower(text), '起居室|客厅|住宅|卧室|living room|residential|home interior') THEN 'indoor_home' ELSE cat0 END AS category,
  CASE WHEN g THEN 'Graphic or title card with a visible logo or title.' ELSE text END AS description, CASE WHEN g THEN 0.6::DOUBLE ELSE conf0 END AS confidence FROM low),
act AS (SELECT doc_id, 'Face-0' || (doc_id % 4 + 1)::VARCHAR AS subject, unnest(['speaking', 'listening', 'speaking', 'looking_at', 'holding', 'using']) AS predicate,
  unnest([NULL, 'group', 'Face-0' || (doc_id % 3 + 1)::VARCHAR, 'Face-0' || (doc_id % 3 + 1)::VARCHAR, 'object:cup', 'cup']) AS object FROM sem)"""

SQL = {
    "person_nodes": sql("speech active timed", f", {_PEOPLE} SELECT * FROM people"),
    "participant_associations": sql("speech active timed", f", {_PEOPLE} SELECT * FROM assoc"),
    "evidence_records": sql("speech active timed", f", {_PEOPLE} SELECT *, sha256(content) AS content_sha256 FROM rec"),
    "identity_candidates": sql("speech active timed", f""", {_PEOPLE} SELECT a.sid, 'person:speaker:' || a.speaker AS source, p.id AS target, a.confidence, coalesce(min(r.start_ms), 0) AS start_ms,
coalesce(max(r.end_ms), 0) AS end_ms, count(r.id) AS n_evidence FROM assoc a JOIN people p ON p.sid = a.sid AND p.face_id = a.face_id LEFT JOIN rec r ON r.sid = a.sid AND r.speaker = a.speaker AND r.face_id = a.face_id
WHERE a.state = 'disputed' GROUP BY ALL"""),
    "face_summaries": sql("active", f""", u AS ({total('(SELECT sid, face_id, start_ms, end_ms + 200 AS end_ms FROM active)', 'sid, face_id')})
SELECT a.*, u.duration_ms AS visible_ms FROM (SELECT sid, face_id, min(start_ms) AS first_ms, max(end_ms) AS last_ms, count(*) AS n, floor(avg(score_u) * 1000000 + 0.5) / 1000000.0 AS mean_score,
  arg_max(segment_id, (score_u, -segment_id)) AS representative FROM active GROUP BY sid, face_id) a JOIN u ON u.sid = a.sid AND u.face_id = a.face_id"""),
    "detection_quality": sql("boxes", """SELECT keyframe_id, state, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence * (0.45::DOUBLE + 0.30::DOUBLE * least(1.0::DOUBLE, sqrt((w * 640) * (h * 360)) / 112.0::DOUBLE)
+ 0.25::DOUBLE * least(1.0::DOUBLE, (sharpness / 1000.0::DOUBLE) / 180.0::DOUBLE)))) * 1000000 + 0.5) / 1000000.0 AS quality FROM boxes"""),
    "turn_topics": sql("turns", f", {_TALK} SELECT DISTINCT sid, turn_id, name FROM tt"),
    "topic_catalog": sql("turns", f", {_TALK} SELECT * FROM topic"),
    "intent_nodes": sql("turns", f""", {_TALK} SELECT i.*, s.speakers FROM its i JOIN (SELECT sid, intent, string_agg(speaker, ',' ORDER BY k) AS speakers FROM (SELECT sid, intent, speaker, min(turn_id) AS k FROM t GROUP BY ALL) GROUP BY ALL) s ON s.sid = i.sid AND s.intent = i.name"""),
    "dialogue_edges": sql("turns", f""", {_TALK} SELECT sid, turn_id, 'person:speaker:' || speaker AS source, 'expresses' AS predicate, 'opinion:' || turn_id::VARCHAR AS target, start_ms, end_ms FROM t
UNION ALL SELECT DISTINCT t.sid, t.turn_id, topic.id, 'about', 'opinion:' || t.turn_id::VARCHAR, t.start_ms, t.end_ms FROM t JOIN tt ON tt.sid = t.sid AND tt.turn_id = t.turn_id JOIN topic ON topic.sid = tt.sid AND topic.name = tt.name
UNION ALL SELECT t.sid, t.turn_id, 'opinion:' || t.turn_id::VARCHAR, 'has_intent', its.id, t.start_ms, t.end_ms FROM t JOIN its ON its.sid = t.sid AND its.name = t.intent"""),
    "environment_repair": f"WITH {_SEM} SELECT doc_id, category, sha256(description) AS description_sha256, confidence FROM rep",
    "canonical_objects": f"""WITH {_SEM} SELECT doc_id, CASE k WHEN 'mic' THEN 'microphone' WHEN 'potted_plant' THEN 'plant' ELSE k END AS label, count(*) AS n FROM (
  SELECT doc_id, {{key}} AS k FROM (SELECT doc_id, category, unnest(labels) AS x FROM rep) WHERE lower(x) NOT IN ('subtitle', 'text') AND (lower(x) <> 'logo' OR category = 'graphic_or_title')) GROUP BY 1, 2""",
    "offline_interactions": f"WITH {_SEM} SELECT * FROM act WHERE predicate NOT IN ('speaking', 'listening') OR object IS NULL OR object = 'group'",
    "live_interactions": f"""WITH {_SEM} SELECT * FROM act WHERE subject IN ('Face-01', 'Face-02', 'Face-03') AND predicate NOT IN ('speaking', 'listening')
AND (object IS NULL OR object IN ('Face-01', 'Face-02', 'Face-03', 'group', 'scene') OR object LIKE 'object:%')""",
    "transcript_interactions": sql("turns scenes", """SELECT DISTINCT c.sid, c.scene_id, 1 AS n, 'Face-0' || (c.sid % 4 + 1)::VARCHAR AS subject, 'speaking' AS predicate, 'group' AS object, 0.9::DOUBLE AS confidence
FROM scenes c JOIN turns t ON t.sid = c.sid AND t.start_ms < c.end_ms AND c.start_ms < t.end_ms WHERE t.speaker = 'assistant'"""),
    "reused_analyses": f"""WITH {_SEM} SELECT k.doc_id AS keyframe_id, s.doc_id AS source_id, CASE WHEN k.doc_id = s.doc_id THEN 'model' ELSE 'visual_reuse' END AS semantic_source, s.cat0 AS category,
CASE WHEN k.doc_id = s.doc_id THEN s.conf0 ELSE floor(s.conf0 * (1 - (k.doc_id % 4) / 10.0::DOUBLE) * 1000000 + 0.5) / 1000000.0 END AS confidence, len(s.labels) AS n_objects,
floor(CASE WHEN k.doc_id = s.doc_id THEN 0.5 ELSE 0.5::DOUBLE * (1 - (k.doc_id % 4) / 10.0::DOUBLE) END * 1000000 + 0.5) / 1000000.0 AS object_confidence, CASE WHEN k.doc_id = s.doc_id THEN 6 ELSE 2 END AS n_interactions
FROM sem k JOIN sem s ON s.doc_id = k.doc_id // 4 * 4""",
    "environment_accuracy": f"""WITH {_SEM} SELECT d.source, count(*) AS n, count(*) FILTER (WHERE rep.category IS NOT DISTINCT FROM CASE WHEN d.lang = 'en' THEN 'indoor_office' ELSE d.lang END) AS "right"
FROM documents d LEFT JOIN rep ON rep.doc_id = d.doc_id WHERE d.n_chars > 100 GROUP BY d.source""",
    "score_records": sql("active", "SELECT sid, t, face_id, segment_id, printf('score-%06d', row_number() OVER (PARTITION BY sid ORDER BY t, face_id, segment_id)) AS record_id FROM (SELECT *, start_ms // 60000 * 40 AS t FROM active)"),
    "observation_runs": sql("active", """, s AS (SELECT DISTINCT sid, face_id, start_ms // 60000 * 40 AS t FROM active),
r AS (SELECT *, sum(f) OVER (PARTITION BY sid, face_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sid, face_id ORDER BY t) <= 2400 THEN 0 ELSE 1 END AS f FROM s))
SELECT sid, face_id, run, count(*) AS n, ceil(min(t) / 40)::BIGINT * 40 AS first_step, floor(max(t) / 40)::BIGINT * 40 AS last_step FROM r GROUP BY sid, face_id, run HAVING count(*) >= 2 AND max(t) - min(t) >= 160"""),
    "segment_records": sql("active", """, s AS (SELECT *, start_ms // 60000 * 40 AS t, segment_id % 7 AS tracklet FROM active WHERE score_u >= 1000),
r AS (SELECT *, sum(f) OVER (PARTITION BY sid, face_id ORDER BY t, tracklet ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sid, face_id ORDER BY t, tracklet) <= 7200 THEN 0 ELSE 1 END AS f FROM s))
SELECT sid, face_id, min(t) AS start_ms, max(t) + 40 AS end_ms, floor(avg(score_u) * 1000000 + 0.5) / 1000000.0 AS score, floor(avg(score_u - 5000) * 1000000 + 0.5) / 1000000.0 AS raw_score,
string_agg(DISTINCT tracklet::VARCHAR, ',' ORDER BY tracklet::VARCHAR) AS tracklets FROM r GROUP BY sid, face_id, g"""),
    "median_smoothing": sql("active", """, a AS (SELECT *, row_number() OVER (PARTITION BY sid, face_id ORDER BY start_ms, segment_id) AS p, count(*) OVER (PARTITION BY sid, face_id) AS n FROM active),
b AS (SELECT *, CASE WHEN n >= 13 THEN 13 WHEN n % 2 = 0 THEN n - 1 ELSE n END AS k FROM a),
c AS (SELECT x.segment_id, x.n, x.k, x.score_u, list(y.score_u) AS v FROM b x JOIN b y ON y.sid = x.sid AND y.face_id = x.face_id AND abs(y.p - x.p) <= x.k // 2 GROUP BY ALL)
SELECT segment_id, CASE WHEN n < 3 THEN score_u ELSE list_sort(list_concat(v, list_transform(range(0, k - len(v)), lambda i: 0::BIGINT)))[(k + 1) // 2] END::DOUBLE AS smooth FROM c"""),
    "evidence_hash": sql("speech active timed", f""", {_BOUND} SELECT sid, sha256('[' || string_agg('{{"face_id":"' || face_id || '","overlap_ms":' || overlap_ms::VARCHAR || ',"speaker":"' || speaker || '"}}', ',' ORDER BY speaker, face_id) || ']') AS evidence_sha256 FROM ev GROUP BY sid"""),
    "scene_extent": sql("turns scenes", """SELECT s.sid, s.start_ms, s.end_ms, s.scenes, coalesce(u.unlinked, 0) AS unlinked FROM (SELECT sid, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS scenes FROM scenes GROUP BY sid) s
LEFT JOIN (SELECT sid, count(*) AS unlinked FROM turns t WHERE NOT EXISTS (SELECT 1 FROM scenes c WHERE c.sid = t.sid AND least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms) >= 1000) GROUP BY sid) u ON u.sid = s.sid"""),
    "pending_requests": """WITH a AS (SELECT lang, source, sha256('v1' || 'model' || lang || sha256(text)) AS request_sha256 FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT lang, request_sha256 FROM a WHERE request_sha256 NOT IN (SELECT request_sha256 FROM a WHERE source = (SELECT min(source) FROM documents WHERE text IS NOT NULL))""",
    "verified_evidence": sql("turns", """, c AS (SELECT sid, turn_id, speaker, start_ms, end_ms, CASE WHEN length(text) > 200 THEN text ELSE coalesce(lag(text) OVER (PARTITION BY sid ORDER BY turn_id), text) END AS text FROM turns),
m AS (SELECT c.sid, c.turn_id, string_agg(t.text, '' ORDER BY t.start_ms, t.turn_id) AS said, min(t.start_ms) AS f, max(t.end_ms) AS l FROM c JOIN turns t ON t.sid = c.sid AND t.speaker = c.speaker AND t.start_ms < c.end_ms AND c.start_ms < t.end_ms GROUP BY ALL)
SELECT c.sid, c.turn_id AS evidence_id, coalesce(f <= c.start_ms + 250 AND l >= c.end_ms - 250 AND contains({bare:said}, {bare:c.text}), false) AS verified FROM c LEFT JOIN m ON m.sid = c.sid AND m.turn_id = c.turn_id"""),
    "ensemble_scores": sql("boxes", "SELECT keyframe_id, state, floor((CASE WHEN w > 0.25::DOUBLE THEN (x + y + w) / 3 ELSE (x + y) / 2 END) * 1000000 + 0.5) / 1000000.0 AS score FROM boxes"),
    "chained_segments": sql("active", """, o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY start_ms, segment_id) AS n FROM active),
k AS (SELECT *, sum(CASE WHEN face_id = p THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY n ROWS UNBOUNDED PRECEDING) AS turn FROM (SELECT *, lag(face_id) OVER (PARTITION BY sid ORDER BY n) AS p FROM o)),
g AS (SELECT *, sum(CASE WHEN start_ms <= m + 600000 THEN 0 ELSE 1 END) OVER (PARTITION BY sid, turn ORDER BY n ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY sid, turn ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k))
SELECT sid, face_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(score_u) AS score, count(*) AS n_parts FROM g GROUP BY sid, turn, g, face_id"""),
    "consistency_violations": sql("speech active", f""", {_BOUND} SELECT 'line_count' AS rule, l_orderkey::VARCHAR AS entity FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) <> count(*)
UNION ALL SELECT 'one_event', user_id::VARCHAR || '/' || event_type FROM events GROUP BY user_id, event_type HAVING count(*) > 1
UNION ALL SELECT 'one_speaker', sid::VARCHAR || '/' || face_id FROM bound WHERE face_id IS NOT NULL GROUP BY sid, face_id HAVING count(*) > 1"""),
}
_SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_STRIP = "regexp_replace({}, '\\A" + _SPACE.replace("{", "{{").replace("}", "}}") + "|" + _SPACE.replace("{", "{{").replace("}", "}}") + "\\z', '', 'g')"
SQL = {k: v.replace("{strip:x}", _STRIP.format("x")).replace("{strip:i}", _STRIP.format("string_split(text, ' ')[1]")).replace("lower(x)", f"lower({_STRIP.format('x')})") for k, v in SQL.items()}
for _c in ("said", "c.text"):
    SQL["verified_evidence"] = SQL["verified_evidence"].replace("{bare:" + _c + "}", f"regexp_replace({_c}, '{_SPACE}', '', 'g')")
SQL["canonical_objects"] = SQL["canonical_objects"].replace("{key}", "replace(trim(regexp_replace(lower(replace(x, '-', ' ')), '" + _SPACE + "', ' ', 'g'), ' '), ' ', '_')")
SQL = {k: v.replace("\n, ", ",\n", 1) if v.count("\n, ") else v for k, v in SQL.items()}
QUERIES = {
    f.__name__: f
    for f in (
        person_nodes, participant_associations, evidence_records, identity_candidates, face_summaries, detection_quality, turn_topics, topic_catalog, intent_nodes,
        dialogue_edges, environment_repair, canonical_objects, offline_interactions, live_interactions, transcript_interactions, reused_analyses, environment_accuracy,
        score_records, observation_runs, segment_records, ensemble_scores, chained_segments, consistency_violations, median_smoothing, evidence_hash, scene_extent, pending_requests, verified_evidence,
    )
}
