"""Live-session, model-request and annotation queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import evaluation, live, scoring, spatial
from ..operators.semantics import request_hash
from . import adapter as A
from .adapter import sql

MINUTE = 60_000


def _frames(spark, d) -> DataFrame:
    """Frames of a session: a change against the frame before, in hundredths."""
    return A.timed_events(spark, d).select("sid", F.col("start_ms").alias("t"), (F.col("score_u") % 100 / 100).alias("change"))


def scene_phases(spark, d) -> DataFrame:
    return live.scene_phases(_frames(spark, d), ["sid"], "t", "change", 0.45, 90 * MINUTE, 240 * MINUTE)


def adaptive_cuts(spark, d) -> DataFrame:
    frames = A.timed_events(spark, d).groupBy("sid", F.col("start_ms").alias("t")).agg(F.max("score_u").alias("content"))
    return live.adaptive_cuts(frames, ["sid"], "t", "content", 2.0, 1500, 60 * MINUTE)


def _states(spark, d) -> DataFrame:
    """Evaluations of a session's bindings: one for each event, of the user's speaker."""
    speaker = F.expr("substring('ABCD', cast((user_id div 8) % 4 + 1 AS int), 1)")
    status = F.expr("CASE event_type WHEN 'error' THEN 'ambiguous' WHEN 'signup' THEN 'unknown' ELSE 'confirmed' END")
    face = F.when(status != "unknown", F.concat(F.lit("Face-0"), (F.col("event_id") % 2 + 1).cast("string")))
    return A.timed_events(spark, d).select("sid", F.col("event_id").alias("n"), speaker.alias("speaker"), face.alias("face_id"), status.alias("status"))


def binding_transitions(spark, d) -> DataFrame:
    return live.binding_transitions(_states(spark, d), ["sid"], "n")


def speaker_labels(spark, d) -> DataFrame:
    return live.speaker_labels(_states(spark, d), ["sid"], "n")


def frame_metrics(spark, d) -> DataFrame:
    rows = A.timed_events(spark, d).withColumn("lag", F.col("score_u") - 2000)
    return live.frame_metrics(rows, ["sid"], ["start_ms", "event_id"], "score_u", "lag")


def event_window(spark, d) -> DataFrame:
    return live.event_window(A.timed_events(spark, d).select("sid", "event_id", "event_type"), ["sid"], "event_id")


def online_faces(spark, d) -> DataFrame:
    rows = A.table(spark, d, "embeddings").where("embedding IS NOT NULL").select(
        F.expr("vec_id div 200").alias("sid"), F.expr("vec_id % 200 div 4").alias("frame"), F.expr("vec_id % 4").alias("det"), F.expr("vec_id % 4 + 1").alias("track"), "embedding"
    )
    return live.online_faces(rows, min_observations=2)


def _reply(asked: list[dict]) -> str:
    """A stand-in for a model: it leaves out long batches' last answer, and never answers two languages of one source."""
    for x in asked:
        if x["lang"] == x["refused"]:
            raise OSError("no answer")
    short = asked[:-1] if len(asked) > 1 and sum(x["n"] for x in asked) % 3 == 0 else asked
    return json.dumps({"keyframes": [{"keyframe_id": x["keyframe_id"], "n": x["n"]} for x in short]})


def semantic_requests(spark, d) -> DataFrame:
    docs = A.table(spark, d, "documents").where("text IS NOT NULL")
    meta = F.to_json(F.struct(F.char_length("text").alias("n"), F.coalesce("lang", F.lit("")).alias("lang"), F.when(F.col("doc_id") % 97 == 96, F.lit("en")).otherwise(F.lit("-")).alias("refused")))
    rows = docs.select(F.expr("doc_id div 50").alias("sid"), F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("keyframe_id"), meta.alias("metadata"))
    return scoring.analyse(rows, _reply, "position")


def cached_answers(spark, d) -> DataFrame:
    docs = A.table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    images = F.array("source", F.col("doc_id").cast("string"))
    named = F.when(F.col("doc_id") % 5 == 0, F.sha2("text", 256)).otherwise(request_hash(F.lit("v1"), F.col("lang"), F.col("text"), F.array_join(images, "")))
    answers = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((F.col("doc_id") % 40 * 2 + i).cast("string").alias("keyframe_id"), F.col("lang").alias("analysis")))
    cache = docs.select(
        F.col("source").alias("sid"), F.concat(F.lit("/cache/"), named, F.lit(".json")).alias("path"), F.col("n_chars").alias("modified"), F.col("lang").alias("model"),
        F.col("text").alias("metadata"), images.alias("images"), answers.alias("answers"),
    )
    return scoring.cached_answers(cache, "v1")


def frame_metadata(spark, d) -> DataFrame:
    s = spatial.person_states(A.boxes(spark, d))
    third = lambda v, low, mid, high: F.when(v < 1 / 3, low).when(v > 2 / 3, high).otherwise(mid)
    people = s.select(
        "keyframe_id", F.when(F.col("state") != 3, F.concat(F.lit("Face-0"), F.col("state").cast("string"))).alias("face_id"), F.lit(None).cast("string").alias("speaker"),
        third(F.col("cx"), "left", "center", "right").alias("horizontal_region"), third(F.col("cy"), "top", "middle", "bottom").alias("vertical_region"),
    )
    frames = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("keyframe_id"))
    shown = F.array_join(F.transform("visible_people", lambda p: F.concat_ws(":", p["face_id"], p["horizontal_region"], p["vertical_region"])), ",")
    return scoring.frame_metadata(frames, people, ["keyframe_id"]).select("keyframe_id", shown.alias("people"))


def aligned_features(spark, d) -> DataFrame:
    e = A.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    rows = e.select("vec_id", (F.col("vec_id") % 40).cast("int").alias("frames"), F.transform("embedding", lambda x: F.array(x.cast("double"))).alias("f"))
    found = rows.withColumn("a", scoring.aligned_features(F.col("f"), F.col("frames"), 1))
    weighted = F.aggregate(F.transform("a", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", "frames", F.size("a").alias("n"), r6(weighted).alias("weighted"))


def sampled_frames(spark, d) -> DataFrame:
    fps = F.expr("CASE source WHEN 'src0' THEN 29.97D WHEN 'src1' THEN 24D WHEN 'src2' THEN 2D ELSE 25D END")
    return scoring.sampled_frames(A.table(spark, d, "documents").select("doc_id", "source"), "doc_id", fps)


def shared_buckets(spark, d) -> DataFrame:
    return evaluation.shared_bucket(A.active(spark, d), ["sid"], "start_ms", "face_id", "one_face", 30 * MINUTE)


def annotation_violations(spark, d) -> DataFrame:
    e = A.timed_events(spark, d)
    frame_id = F.concat(F.lit("keyframe-"), F.lpad((F.col("user_id") % 90 + 99_950).cast("string"), 5, "0"))
    frame_id = F.when(F.col("user_id") % 90 >= 50, F.concat(frame_id, F.lit("x"))).otherwise(frame_id)
    kind = F.expr("CASE event_type WHEN 'view' THEN 'speaking' WHEN 'click' THEN 'left_of' ELSE 'sitting_with' END")
    relations = e.where("event_type NOT IN ('signup', 'purchase')").select(
        "sid", frame_id.alias("keyframe_id"), F.lit("interactions").alias("field"), F.expr("CASE WHEN event_id % 50 > 0 THEN 'p' || event_id % 7 ELSE '' END").alias("subject"),
        kind.alias("predicate"), F.when(F.col("score_u") % 3 > 0, F.concat(F.lit("p"), F.col("user_id") % 7)).alias("object"),
    )
    frames = e.where("event_type IN ('signup', 'purchase')").select(
        "sid", frame_id.alias("keyframe_id"), (F.col("score_u") - 100).alias("timestamp_ms"),
        F.expr("CASE score_u % 4 WHEN 0 THEN 'stage' WHEN 1 THEN 'cellar' WHEN 2 THEN 'vehicle' END").alias("environment_category"),
        F.expr("CASE score_u % 7 WHEN 0 THEN array('Cup', ' ') WHEN 1 THEN array('Coffee_Cup', 'coffee cup') WHEN 2 THEN array('chair', 'lamp') WHEN 3 THEN array('Chair') END").alias("object_labels"),
    )
    return evaluation.annotation_violations(frames, relations, ["sid"], ["chair", "cup", "coffee cup"])


_SPACED = """{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t) AS n FROM {src}),
{name}_r AS (SELECT {keys}, n, t, t AS kept, true AS k FROM {name} WHERE n = 1
  UNION ALL SELECT {ckeys}, o.n, o.t, CASE WHEN o.t >= r.kept + {gap} THEN o.t ELSE r.kept END, o.t >= r.kept + {gap} FROM {name}_r r JOIN {name} o ON {on} AND o.n = r.n + 1)"""


def _spaced(name: str, src: str, keys: list[str], gap: int) -> str:
    return _SPACED.format(name=name, src=src, keys=", ".join(keys), ckeys=", ".join(f"o.{k}" for k in keys), on=" AND ".join(f"o.{k} = r.{k}" for k in keys), gap=gap)


_STATES = """st AS (SELECT sid, n, speaker, CASE WHEN status <> 'unknown' THEN face END AS face_id, status FROM (
  SELECT sid, event_id AS n, substring('ABCD', ((user_id // 8) % 4 + 1)::INT, 1) AS speaker, 'Face-0' || (event_id % 2 + 1)::VARCHAR AS face,
    CASE event_type WHEN 'error' THEN 'ambiguous' WHEN 'signup' THEN 'unknown' ELSE 'confirmed' END AS status FROM timed)),
ch AS (SELECT *, lag(face_id) OVER w AS pf, lag(status) OVER w AS ps, row_number() OVER w AS p FROM st WINDOW w AS (PARTITION BY sid, speaker ORDER BY n)),
lo AS (SELECT *, p > 1 AND ps = 'confirmed' AND (status <> 'confirmed' OR face_id IS DISTINCT FROM pf) AS lost FROM ch)"""
_RELATION = "CASE WHEN predicate = 'sitting_with' AND coalesce(object, '') < subject THEN ({}) ELSE ({}) END"

SQL = {
    "scene_phases": "WITH RECURSIVE" + sql("timed", f""", fr AS (SELECT sid, start_ms AS t, max(score_u % 100 / 100.0::DOUBLE) AS d FROM timed GROUP BY ALL),
fp AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY t) AS p FROM fr), cand AS (SELECT sid, t FROM fp WHERE p = 1 OR d >= 0.45),
{_spaced("c1", "cand", ["sid"], 90 * MINUTE)},
sc AS (SELECT sid, t AS start_ms, row_number() OVER w AS scene, lead(t) OVER w AS end_ms FROM c1_r WHERE k WINDOW w AS (PARTITION BY sid ORDER BY t)),
pl AS (SELECT fr.sid, scene, t FROM fr JOIN sc ON sc.sid = fr.sid AND t >= start_ms AND (end_ms IS NULL OR t < end_ms)),
{_spaced("c2", "pl", ["sid", "scene"], 240 * MINUTE)}
SELECT sid, t, scene, CASE WHEN t = start_ms THEN 'scene_changed' ELSE 'scene_sampled' END AS event, start_ms, end_ms FROM c2_r JOIN sc USING (sid, scene) WHERE k""").removeprefix("WITH"),
    "adaptive_cuts": "WITH RECURSIVE" + sql("timed", f""", fr AS (SELECT sid, start_ms AS t, max(score_u) AS c FROM timed GROUP BY ALL),
ne AS (SELECT *, (lag(c, 2) OVER w + lag(c, 1) OVER w + lead(c, 1) OVER w + lead(c, 2) OVER w) / 4.0 AS mean, row_number() OVER w AS p FROM fr WINDOW w AS (PARTITION BY sid ORDER BY t)),
cand AS (SELECT sid, t FROM ne WHERE p = 1 OR (c >= 1500 AND mean IS NOT NULL AND (mean < 0.00001 OR c / mean >= 2.0))),
{_spaced("c1", "cand", ["sid"], 60 * MINUTE)}
SELECT sid, t FROM c1_r WHERE k AND n > 1""").removeprefix("WITH"),
    "binding_transitions": sql("timed", f""", {_STATES}
SELECT sid, n, speaker, face_id, status, emitted, superseded_face, edge_no FROM (
  SELECT *, status = 'confirmed' AS emitted, CASE WHEN lost THEN pf END AS superseded_face,
    count(*) FILTER (WHERE status = 'confirmed') OVER (PARTITION BY sid, speaker ORDER BY n) AS edge_no
  FROM lo WHERE p = 1 OR face_id IS DISTINCT FROM pf OR status <> ps)"""),
    "speaker_labels": sql("timed", f""", {_STATES},
acts AS (SELECT sid, n, speaker AS who, 0 AS step, pf AS face_id, NULL AS speaker FROM lo WHERE lost
  UNION ALL SELECT sid, n, speaker, 1, face_id, speaker FROM lo WHERE status = 'confirmed')
SELECT sid, face_id, speaker FROM acts QUALIFY row_number() OVER (PARTITION BY sid, face_id ORDER BY n DESC, who DESC, step DESC) = 1"""),
    "frame_metrics": sql("timed", """, ra AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY start_ms DESC, event_id DESC) AS r FROM timed)
SELECT sid, count(*) AS sampled_frames, floor(avg(score_u) * 1000000 + 0.5) / 1000000.0 AS mean_latency, (quantile_disc(score_u, 0.5) FILTER (WHERE r <= 1000))::DOUBLE AS p50_recent,
  (quantile_disc(score_u, 0.95) FILTER (WHERE r <= 1000))::DOUBLE AS p95_recent, max(score_u) AS max_latency, greatest(0, max(score_u - 2000)) AS max_lag FROM ra GROUP BY sid"""),
    "event_window": sql("timed", "SELECT sid, event_id, event_type FROM timed QUALIFY row_number() OVER (PARTITION BY sid ORDER BY event_id DESC) <= 100"),
    "semantic_requests": """WITH d AS (SELECT doc_id // 50 AS sid, doc_id, length(text) AS n, doc_id % 97 = 96 AND coalesce(lang, '') = 'en' AS refused,
  row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, (k + 2) // 3 AS batch, sum(n) OVER w AS total, count(*) OVER w AS size, row_number() OVER (w ORDER BY doc_id) AS part FROM d WINDOW w AS (PARTITION BY sid, (k + 2) // 3)),
f AS (SELECT b.*, coalesce(batch - stop, -1) AS late FROM b LEFT JOIN (SELECT sid, min(batch) AS stop FROM b WHERE refused GROUP BY sid) USING (sid))
SELECT sid, doc_id::VARCHAR AS keyframe_id, 'semantic-batch-' || lpad(batch::VARCHAR, 5, '0') || CASE WHEN late < 0 AND size > 1 AND total % 3 = 0 THEN '-part-' || lpad(part::VARCHAR, 2, '0') ELSE '' END AS batch_id,
  CASE WHEN late < 0 THEN '{"keyframe_id": "' || doc_id::VARCHAR || '", "n": ' || n::VARCHAR || '}' END AS analysis,
  CASE WHEN late < 0 THEN 'done' WHEN late = 0 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN late = 0 THEN 'no answer' END AS error FROM f""",
    "cached_answers": """WITH c AS (SELECT source AS sid, doc_id, n_chars AS modified, lang, sha256('v1' || lang || text || source || doc_id::VARCHAR) AS stem
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND doc_id % 5 <> 0),
a AS (SELECT sid, modified, '/cache/' || stem || '.json' AS path, lang AS analysis, (doc_id % 40 * 2 + unnest(range(0, 3)))::VARCHAR AS keyframe_id FROM c)
SELECT sid, keyframe_id, analysis, path FROM a QUALIFY row_number() OVER (PARTITION BY sid, keyframe_id ORDER BY modified DESC, path DESC) = 1""",
    "frame_metadata": sql("boxes", """, pe AS (SELECT keyframe_id, state, 'Face-0' || state::VARCHAR || ':' || CASE WHEN x + w / 2 < 1 / 3 THEN 'left' WHEN x + w / 2 > 2 / 3 THEN 'right' ELSE 'center' END
  || ':' || CASE WHEN y + h / 2 < 1 / 3 THEN 'top' WHEN y + h / 2 > 2 / 3 THEN 'bottom' ELSE 'middle' END AS p FROM boxes WHERE state <> 3),
g AS (SELECT keyframe_id, string_agg(p, ',' ORDER BY p) AS people FROM pe GROUP BY keyframe_id)
SELECT o_orderkey AS keyframe_id, coalesce(people, '') AS people FROM orders LEFT JOIN g ON o_orderkey = keyframe_id"""),
    "aligned_features": """WITH e AS (SELECT vec_id, (vec_id % 40)::INT AS frames, embedding::DOUBLE[] AS f FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT vec_id, frames, unnest(range(0, frames * 4)) AS i, f FROM e),
s AS (SELECT vec_id, list(f[1 + i % len(f)] * (i + 1) ORDER BY i) AS v FROM x GROUP BY vec_id)
SELECT e.vec_id, frames, frames * 4 AS n, floor(coalesce(list_reduce(v, lambda a, b: a + b), 0.0) * 1000000 + 0.5) / 1000000.0 AS weighted FROM e LEFT JOIN s USING (vec_id)""",
    "sampled_frames": """WITH f AS (SELECT doc_id, source, CASE source WHEN 'src0' THEN 29.97::DOUBLE WHEN 'src1' THEN 24 WHEN 'src2' THEN 2 ELSE 25 END AS fps FROM documents)
SELECT doc_id, source, round_even(doc_id * 1000 / fps, 0)::BIGINT AS timestamp_ms FROM f WHERE doc_id % greatest(1, round_even(fps / 5, 0)::BIGINT) = 0""",
    "shared_buckets": sql("active", f"""SELECT 'one_face' AS rule, sid::VARCHAR || '/' || (round_even(start_ms / {30 * MINUTE}, 0)::BIGINT)::VARCHAR AS entity FROM active
GROUP BY sid, round_even(start_ms / {30 * MINUTE}, 0)::BIGINT HAVING count(DISTINCT face_id) > 1"""),
    "annotation_violations": sql("timed", f""", ids AS (SELECT *, 'keyframe-' || lpad((user_id % 90 + 99950)::VARCHAR, 5, '0') || CASE WHEN user_id % 90 >= 50 THEN 'x' ELSE '' END AS kf FROM timed),
fr AS (SELECT sid, kf, sid::VARCHAR || '/' || kf AS entity, score_u - 100 AS t, CASE score_u % 4 WHEN 0 THEN 'stage' WHEN 1 THEN 'cellar' WHEN 2 THEN 'vehicle' END AS c,
  CASE score_u % 7 WHEN 0 THEN 'blank_label' WHEN 1 THEN 'label_twice' WHEN 2 THEN 'outside_vocabulary' END AS fault, score_u % 7 <= 3 AS labelled FROM ids WHERE event_type IN ('signup', 'purchase')),
re AS (SELECT sid, kf, sid::VARCHAR || '/' || kf AS entity, CASE WHEN event_id % 50 > 0 THEN 'p' || (event_id % 7)::VARCHAR ELSE '' END AS subject,
  CASE event_type WHEN 'view' THEN 'speaking' WHEN 'click' THEN 'left_of' ELSE 'sitting_with' END AS predicate, CASE WHEN score_u % 3 > 0 THEN 'p' || (user_id % 7)::VARCHAR END AS object
  FROM ids WHERE event_type NOT IN ('signup', 'purchase'))
SELECT 'keyframe_id' AS rule, entity FROM fr WHERE length(kf) <> 14
UNION ALL SELECT 'keyframe_twice', entity FROM fr GROUP BY entity HAVING count(*) > 1
UNION ALL SELECT 'timestamp', entity FROM fr WHERE t < 0
UNION ALL SELECT 'no_dimension', entity FROM fr WHERE c IS NULL AND NOT labelled AND entity NOT IN (SELECT entity FROM re)
UNION ALL SELECT 'category', entity FROM fr WHERE c = 'cellar'
UNION ALL SELECT fault, entity FROM fr WHERE fault IS NOT NULL
UNION ALL SELECT 'no_subject', entity FROM re WHERE subject = ''
UNION ALL SELECT 'predicate', entity FROM re WHERE predicate = 'left_of'
UNION ALL SELECT 'relation_twice', entity FROM re GROUP BY entity, predicate, {_RELATION.format("coalesce(object, '')", "subject")}, {_RELATION.format("subject", "coalesce(object, '')")} HAVING count(*) > 1"""),
}
SQL = {k: v.replace("\n, ", ",\n", 1) if v.count("\n, ") else v for k, v in SQL.items()}
QUERIES = {
    f.__name__: f
    for f in (
        scene_phases, adaptive_cuts, binding_transitions, speaker_labels, frame_metrics, event_window, online_faces, semantic_requests, cached_answers, frame_metadata, aligned_features,
        sampled_frames, shared_buckets, annotation_violations,
    )
}
