"""Interval, binding and activity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import nearest_rank, r6
from ..operators import activity, binding, intervals
from ..sources.documents import checkpointed
from . import adapter as A
from .adapter import sql

HOUR = 3_600_000


def interval_merge(spark, d) -> DataFrame:
    return intervals.merge_intervals(A.speech(spark, d), ["sid", "speaker"])


def interval_merge_ids(spark, d) -> DataFrame:
    spans = A.speech(spark, d).withColumn("ids", F.array("span_id"))
    merged = intervals.merge_intervals(spans, ["sid", "speaker"], gap_ms=60_000, ids="ids")
    return merged.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


def union_duration(spark, d) -> DataFrame:
    return intervals.union_duration(A.speech(spark, d), ["sid", "speaker"])


def union_duration_padded(spark, d) -> DataFrame:
    return intervals.union_duration(A.active(spark, d), ["sid", "face_id"], pad_ms=200_000)


def _overlaps(spark, d, bucket) -> DataFrame:
    pairs = intervals.overlap_join(A.speech(spark, d), A.active(spark, d), ["sid"], bucket)
    return pairs.select("sid", "span_id", F.col("r_segment_id").alias("segment_id"), "overlap_start", "overlap_end", "overlap_ms")


def interval_overlap_join(spark, d) -> DataFrame:
    return _overlaps(spark, d, HOUR)


def overlap_bucketed(spark, d) -> DataFrame:
    return _overlaps(spark, d, 10 * 60_000)


def overlap_closed_end(spark, d) -> DataFrame:
    pairs = intervals.overlap_join(A.speech(spark, d), A.active(spark, d), ["sid"], HOUR, closed_end=True)
    return pairs.groupBy("sid", "span_id").agg(F.count(F.lit(1)).alias("n_segments"))


def span_face_candidates(spark, d) -> DataFrame:
    return binding.span_candidates(A.speech(spark, d), A.active(spark, d))


def overlap_evidence(spark, d) -> DataFrame:
    return binding.evidence(A.speech(spark, d), A.active(spark, d))


def assignment_max_overlap(spark, d) -> DataFrame:
    return binding.assign(binding.evidence(A.speech(spark, d), A.active(spark, d)))


def binding_status(spark, d) -> DataFrame:
    return binding.bind(A.speech(spark, d), A.active(spark, d), min_coverage=0.1, min_margin=0.01)


def binding_status_online(spark, d) -> DataFrame:
    return binding.bind(A.speech(spark, d), A.active(spark, d), min_coverage=0.1, min_margin=0.01, online=True)


def relabel_corrections(spark, d) -> DataFrame:
    s, a = A.speech(spark, d), A.active(spark, d)
    bound = binding.bind(s, a, min_coverage=0.1, min_margin=0.01)
    return binding.relabel(s, a, bound, min_confidence=0.1)


def reconcile_fixpoint(spark, d) -> DataFrame:
    spans, passes, stable = binding.reconcile(A.speech(spark, d), A.active(spark, d), min_coverage=0.1, min_margin=0.01)
    return spans.withColumns({"passes": F.lit(passes), "stable": F.lit(stable)})


def _of_faces(spark, d) -> DataFrame:
    """Merged coverage of the four speakers, by the face of the same number."""
    speaker = F.element_at(F.create_map(*[F.lit(x) for n, s in enumerate("ABCD") for x in (f"Face-0{n + 1}", s)]), F.col("face_id"))
    cover = A.active(spark, d).withColumn("speaker", speaker).where("speaker IS NOT NULL")
    return intervals.merge_intervals(cover, ["sid", "speaker"]).select("sid", "speaker", "start_ms", "end_ms")


def _spoken(spark, d) -> DataFrame:
    return intervals.merge_intervals(A.speech(spark, d), ["sid", "speaker"]).select("sid", "speaker", "start_ms", "end_ms")


def elementary_visibility(spark, d) -> DataFrame:
    return intervals.elementary_states(_spoken(spark, d), _of_faces(spark, d), A.cuts(spark, d), ["sid", "speaker"], occlusion_max_ms=1_800_000, tolerance_ms=240_000)


def merge_state_segments(spark, d) -> DataFrame:
    return intervals.merge_states(elementary_visibility(spark, d), ["sid"], ["speaker", "state", "reason"])


def visibility_classification(spark, d) -> DataFrame:
    s, a = A.speech(spark, d), A.active(spark, d)
    bound = checkpointed(binding.bind(s, a, min_coverage=0.1, min_margin=0.01), "bindings")  # four rows for a session, read several times
    cover = intervals.merge_intervals(a, ["sid", "face_id"]).select("sid", "face_id", "start_ms", "end_ms")
    return intervals.classify_visibility(_spoken(spark, d), bound, cover, A.cuts(spark, d), occlusion_max_ms=1_800_000, tolerance_ms=240_000)


def padded_coverage(spark, d) -> DataFrame:
    """Sessions last until the first of February."""
    return intervals.padded_coverage(A.active(spark, d), ["sid", "face_id"], 200_000, 1706745600000)


def shot_coverage(spark, d) -> DataFrame:
    """Shots between the cuts of a day; sessions without cuts are one shot."""
    t = A.timed_events(spark, d)
    sessions = t.groupBy("sid").agg((F.max("end_ms") + 1000).alias("duration_ms"))
    marks = A.cuts(spark, d).select("sid", F.expr("cut_ms div 86400000 * 86400000").alias("start_ms")).distinct()
    shots = marks.withColumn("end_ms", F.lead("start_ms").over(W.partitionBy("sid").orderBy("start_ms"))).fillna({"end_ms": 0})
    return intervals.full_coverage(shots, sessions, ["sid"])


def cuts_semijoin(spark, d) -> DataFrame:
    return intervals.points_within(A.active(spark, d), A.cuts(spark, d), ["sid"], "cut_ms", HOUR)


def split_long_intervals(spark, d) -> DataFrame:
    return intervals.split_long(A.speech(spark, d), 30 * 60_000)


def shot_transcript_topk(spark, d) -> DataFrame:
    pairs = intervals.overlap_join(A.scenes(spark, d), A.turns(spark, d), ["sid"], 4000)
    w = W.partitionBy("sid", "scene_id").orderBy("r_start_ms", "r_turn_id")
    return pairs.withColumn("n", F.row_number().over(w)).where("n <= 20").select("sid", "scene_id", F.col("r_turn_id").alias("turn_id"), "n")


def resample_interpolate(spark, d) -> DataFrame:
    points = A.active(spark, d).groupBy("sid", "face_id", F.expr("start_ms div 60000 * 60").alias("t")).agg(F.min("score_u").cast("double").alias("v"))
    return intervals.interpolate(points, ["sid", "face_id"], 7200, ["v"]).withColumn("v", r6(F.col("v")))


def moving_average(spark, d) -> DataFrame:
    rows = activity.moving_average(A.active(spark, d), ["sid", "face_id"], ["start_ms", "segment_id"], "score_u")
    return rows.select("segment_id", "total", "n")


def run_length_postprocess(spark, d) -> DataFrame:
    rows = activity.postprocess(A.active(spark, d), ["sid", "face_id"], ["start_ms", "segment_id"], F.col("score_u") >= 3000, bridge=2, least=3)
    return rows.select("segment_id", "p", "active")


def exclusive_winner(spark, d) -> DataFrame:
    rows = A.active(spark, d).withColumn("t", F.expr("start_ms div 3600000 * 40"))
    marked = activity.exclusive(rows, ["sid"], "t", [F.desc("score_u"), F.col("face_id"), F.col("segment_id")])
    return marked.where("winner").select("sid", "bucket", "segment_id", "face_id", "score_u")


def activity_segments(spark, d) -> DataFrame:
    rows = A.active(spark, d).withColumn("t", F.expr("start_ms div 60000")).where("score_u >= 1000")
    return activity.segments(rows, ["sid", "face_id"], "t", gap_ms=180)


def sliding_context_window(spark, d) -> DataFrame:
    """Windows of four hours every hour; only the newest hour of each is published."""
    hop, size = HOUR, 4 * HOUR
    rows = A.active(spark, d)
    ends = F.expr(f"transform(sequence(0, 3), k -> (start_ms div {hop} + 1 + k) * {hop})")
    w = rows.withColumn("window_end", F.explode(ends))
    return w.groupBy("sid", "window_end").agg(
        F.count(F.lit(1)).alias("n_context"), F.count_if(F.col("start_ms") >= F.col("window_end") - hop).alias("n_published"),
        F.count_distinct("face_id").alias("n_faces"), (F.max("window_end") - size).alias("window_start"),
    )


def speaking_state_machine(spark, d) -> DataFrame:
    rows = A.active(spark, d).select("sid", "face_id", F.expr("start_ms div 60000 * 40").alias("t"), (F.col("score_u") >= 500).alias("speaking"))
    last = F.expr("1704067200000 div 60000 * 40 + 31 * 1440 * 40")
    return activity.speaking_phases(rows, ["sid", "face_id"], last, confirm_ms=80, silence_ms=4000)


def percentile_nearest_rank(spark, d) -> DataFrame:
    return A.timed_events(spark, d).groupBy("sid").agg(nearest_rank("score_u", 0.5).alias("p50"), nearest_rank("score_u", 0.95).alias("p95"))


_MERGE = """
SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms{more} FROM (
  SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms{tie} ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms{tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS f
    FROM {src}))
GROUP BY {keys}, g"""


def merged(src: str, keys: str, gap: int = 0, more: str = "", tie: str = "") -> str:
    return _MERGE.format(src=src, keys=keys, gap=gap, more=more, tie=tie)


def total(src: str, keys: str) -> str:
    return f"SELECT {keys}, sum(end_ms - start_ms)::BIGINT AS duration_ms FROM ({merged(src, keys)}) GROUP BY {keys}"


_PAIRS = """SELECT s.sid, s.span_id, s.speaker, a.segment_id, a.face_id, greatest(s.start_ms, a.start_ms) AS start_ms, least(s.end_ms, a.end_ms) AS end_ms
FROM speech s JOIN active a ON s.sid = a.sid AND s.start_ms < a.end_ms AND a.start_ms < s.end_ms"""
_OVERLAP = f"SELECT sid, span_id, segment_id, start_ms AS overlap_start, end_ms AS overlap_end, end_ms - start_ms AS overlap_ms FROM ({_PAIRS})"
_CANDIDATES = f"""SELECT sid, span_id, face_id, duration_ms AS overlap_ms, row_number() OVER (PARTITION BY sid, span_id ORDER BY duration_ms DESC, face_id) AS rank
FROM ({total(f"({_PAIRS})", "sid, span_id, face_id")})"""
_EVIDENCE = f"SELECT sid, speaker, face_id, duration_ms AS overlap_ms FROM ({total(f'({_PAIRS})', 'sid, speaker, face_id')})"
_CHOICE = "(SELECT sid, face_id AS f, overlap_ms AS o FROM ev WHERE speaker = '{0}' AND overlap_ms > 0 UNION ALL SELECT sid, NULL, 0 FROM ss) {0}"
_ASSIGN = f"""
ss AS (SELECT DISTINCT sid FROM ev),
pick AS (
  SELECT A.sid, A.f AS fa, B.f AS fb, C.f AS fc, D.f AS fd, row_number() OVER (PARTITION BY A.sid ORDER BY A.o + B.o + C.o + D.o DESC,
    coalesce(A.f, '~'), coalesce(B.f, '~'), coalesce(C.f, '~'), coalesce(D.f, '~')) AS n
  FROM {_CHOICE.format("A")} JOIN {_CHOICE.format("B")} ON A.sid = B.sid JOIN {_CHOICE.format("C")} ON A.sid = C.sid JOIN {_CHOICE.format("D")} ON A.sid = D.sid
  WHERE (A.f IS NULL OR B.f IS NULL OR A.f <> B.f) AND (A.f IS NULL OR C.f IS NULL OR A.f <> C.f) AND (A.f IS NULL OR D.f IS NULL OR A.f <> D.f)
    AND (B.f IS NULL OR C.f IS NULL OR B.f <> C.f) AND (B.f IS NULL OR D.f IS NULL OR B.f <> D.f) AND (C.f IS NULL OR D.f IS NULL OR C.f <> D.f)),
chosen AS (SELECT sid, unnest(['A', 'B', 'C', 'D']) AS speaker, unnest([fa, fb, fc, fd]) AS face_id FROM pick WHERE n = 1)"""
_BIND = f"""
ev AS ({_EVIDENCE}), {_ASSIGN},
spoken AS (SELECT sid, speaker, duration_ms AS speech_ms FROM ({total("speech", "sid, speaker")})),
act AS (SELECT sid, face_id, duration_ms AS active_ms FROM ({total("active", "sid, face_id")})),
other AS (SELECT ev.sid, ev.speaker, coalesce(max(ev.overlap_ms) FILTER (WHERE c.face_id IS NULL OR ev.face_id <> c.face_id), 0) AS runner_up_ms, count(*) AS n
  FROM ev LEFT JOIN chosen c ON c.sid = ev.sid AND c.speaker = ev.speaker GROUP BY ALL),
b AS (SELECT s.sid, s.speaker, c.face_id, coalesce(ev.overlap_ms, 0) AS overlap_ms, s.speech_ms, coalesce(act.active_ms, 0) AS active_ms,
  coalesce(o.runner_up_ms, 0) AS runner_up_ms, coalesce(o.n, 0) AS n
  FROM spoken s LEFT JOIN chosen c ON c.sid = s.sid AND c.speaker = s.speaker LEFT JOIN ev ON ev.sid = s.sid AND ev.speaker = s.speaker AND ev.face_id = c.face_id
  LEFT JOIN other o ON o.sid = s.sid AND o.speaker = s.speaker LEFT JOIN act ON act.sid = s.sid AND act.face_id = c.face_id),
m AS (SELECT *, overlap_ms / speech_ms AS c, CASE WHEN active_ms > 0 THEN overlap_ms / active_ms ELSE 0.0 END AS p, (overlap_ms - runner_up_ms) / speech_ms AS mg,
  CASE WHEN overlap_ms > 0 THEN greatest(0.0, (overlap_ms - runner_up_ms) / overlap_ms) ELSE 0.0 END AS dm FROM b),
bound AS (SELECT sid, speaker, face_id, overlap_ms, speech_ms, active_ms, runner_up_ms, floor(c * 1000000 + 0.5) / 1000000.0 AS coverage,
  floor(p * 1000000 + 0.5) / 1000000.0 AS purity, floor(mg * 1000000 + 0.5) / 1000000.0 AS margin,
  floor(least(1.0, greatest(0.0, 0.6::DOUBLE * c + 0.25::DOUBLE * p + 0.15::DOUBLE * dm)) * 1000000 + 0.5) / 1000000.0 AS confidence, {{status}} AS status FROM m)"""
_OFFLINE = """CASE WHEN face_id IS NULL AND n > 0 THEN 'ambiguous' WHEN face_id IS NULL THEN 'offscreen' WHEN overlap_ms < 3000 THEN 'candidate'
  WHEN mg < 0.01 THEN 'ambiguous' WHEN c < 0.1 THEN 'candidate' ELSE 'confirmed' END"""
_ONLINE = """CASE WHEN face_id IS NULL THEN 'offscreen' WHEN overlap_ms < 3000 OR c < 0.1 THEN 'candidate' WHEN mg < 0.01 THEN 'ambiguous' ELSE 'confirmed' END"""
_PIECES = f"""
cv AS (SELECT sid, {{key}}, start_ms AS c0, end_ms AS c1 FROM ({{cover}})),
cl AS (SELECT sp.sid, sp.speaker, s0, e0, greatest(c0, s0) AS l, least(c1, e0) AS r FROM {{sp}} sp JOIN cv ON cv.sid = sp.sid AND cv.{{key}} = sp.{{key}} AND c1 > s0 AND c0 < e0),
pt AS (SELECT sid, speaker, s0, e0, s0 AS p FROM {{sp}} UNION SELECT sid, speaker, s0, e0, e0 FROM {{sp}} UNION SELECT sid, speaker, s0, e0, l FROM cl UNION SELECT sid, speaker, s0, e0, r FROM cl),
pc AS (SELECT * FROM (SELECT sid, speaker, s0, e0, p AS s, lead(p) OVER (PARTITION BY sid, speaker, s0, e0 ORDER BY p) AS e FROM pt) WHERE e > s),
st AS (SELECT pc.*, coalesce(bool_or(l <= (s + e) // 2 AND (s + e) // 2 < r), false) AS cov, max(r) FILTER (WHERE r <= s) AS pv, min(l) FILTER (WHERE l >= e) AS nx
  FROM pc LEFT JOIN cl ON cl.sid = pc.sid AND cl.speaker = pc.speaker AND cl.s0 = pc.s0 AND cl.e0 = pc.e0 GROUP BY ALL),
k AS (SELECT *, (s = s0 OR e = e0) AND e - s <= 240000 AS edge, pv IS NOT NULL AND nx IS NOT NULL AND nx - pv <= 1800000
  AND NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.sid = st.sid AND cut_ms BETWEEN pv AND nx) AS br FROM st),
vis AS (SELECT sid, speaker, s AS start_ms, e AS end_ms, CASE WHEN cov OR edge THEN 'visible' WHEN br THEN 'occluded' ELSE 'offscreen' END AS state,
  CASE WHEN cov THEN 'face_track_present' WHEN edge THEN 'timestamp_boundary_tolerance' WHEN br THEN 'short_gap_within_same_shot' ELSE 'bound_face_absent' END AS reason,
  CASE WHEN cov OR edge THEN NULL WHEN br THEN 0.65::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM k)"""
_SPOKEN = f"sp AS (SELECT sid, speaker, start_ms AS s0, end_ms AS e0 FROM ({merged('speech', 'sid, speaker')}))"
_STATES = f"{_SPOKEN}, " + _PIECES.format(sp="sp", key="speaker", cover=merged("(SELECT sid, chr(64 + right(face_id, 1)::INT) AS speaker, start_ms, end_ms FROM active WHERE right(face_id, 1)::INT <= 4)", "sid, speaker"))


def _joined(src: str, same: str) -> str:
    order = f"sid ORDER BY start_ms, end_ms, {same}"
    agree = " AND ".join(f"lag({c}) OVER w IS NOT DISTINCT FROM {c}" for c in same.split(", "))
    return f"""SELECT sid, {same}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_rows FROM (
  SELECT *, sum(f) OVER (PARTITION BY {order} ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN {agree} AND start_ms <= lag(end_ms) OVER w THEN 0 ELSE 1 END AS f FROM {src} WINDOW w AS (PARTITION BY {order})))
GROUP BY sid, g, {same}"""


SQL = {
    "interval_merge": sql("speech", merged("speech", "sid, speaker", more=", count(*) AS n_merged")),
    "interval_merge_ids": sql("speech", merged("speech", "sid, speaker", gap=60000, more=", count(*) AS n_merged, string_agg(span_id::VARCHAR, ',' ORDER BY start_ms, end_ms, span_id) AS ids")),
    "union_duration": sql("speech", total("speech", "sid, speaker")),
    "union_duration_padded": sql("active", total("(SELECT sid, face_id, start_ms, end_ms + 200000 AS end_ms FROM active)", "sid, face_id")),
    "interval_overlap_join": sql("speech active", _OVERLAP),
    "overlap_bucketed": sql("speech active", _OVERLAP),
    "overlap_closed_end": sql("speech active", "SELECT s.sid, s.span_id, count(*) AS n_segments FROM speech s JOIN active a ON s.sid = a.sid AND a.end_ms >= s.start_ms AND a.start_ms < s.end_ms GROUP BY ALL"),
    "span_face_candidates": sql("speech active", _CANDIDATES),
    "overlap_evidence": sql("speech active", _EVIDENCE),
    "assignment_max_overlap": sql("speech active", f", ev AS ({_EVIDENCE}), {_ASSIGN} SELECT * FROM chosen"),
    "binding_status": sql("speech active", f", {_BIND.format(status=_OFFLINE)} SELECT * FROM bound"),
    "binding_status_online": sql("speech active", f", {_BIND.format(status=_ONLINE)} SELECT * FROM bound"),
    "relabel_corrections": sql("speech active", f""", {_BIND.format(status=_OFFLINE)}, cand AS ({_CANDIDATES}),
tops AS (SELECT sid, span_id, max(face_id) FILTER (WHERE rank = 1) AS face_id, max(overlap_ms) FILTER (WHERE rank = 1) AS o, coalesce(max(overlap_ms) FILTER (WHERE rank = 2), 0) AS o2 FROM cand GROUP BY ALL)
SELECT s.sid, s.span_id, s.speaker AS original_speaker, b.speaker, t.face_id, t.o AS overlap_ms, floor(t.o / (s.end_ms - s.start_ms) * 1000000 + 0.5) / 1000000.0 AS coverage,
  floor((t.o - t.o2) / t.o * 1000000 + 0.5) / 1000000.0 AS dominance
FROM speech s JOIN tops t ON t.sid = s.sid AND t.span_id = s.span_id JOIN bound b ON b.sid = s.sid AND b.face_id = t.face_id AND b.status = 'confirmed' AND b.confidence >= 0.1
WHERE b.speaker <> s.speaker AND t.o >= 1200 AND t.o / (s.end_ms - s.start_ms) >= 0.6 AND (t.o - t.o2) / t.o >= 0.6"""),
    "elementary_visibility": sql("speech active cuts", f", {_STATES} SELECT * FROM vis"),
    "merge_state_segments": sql("speech active cuts", f", {_STATES} {_joined('vis', 'speaker, state, reason')}"),
    "visibility_classification": sql("speech active cuts", f""", {_BIND.format(status=_OFFLINE)}, {_SPOKEN},
sb AS (SELECT sp.*, face_id, status, confidence AS bc FROM sp LEFT JOIN bound USING (sid, speaker)),
sf AS (SELECT * FROM sb WHERE status NOT IN ('candidate', 'ambiguous', 'offscreen') AND face_id IS NOT NULL),
{_PIECES.format(sp="sf", key="face_id", cover=merged("active", "sid, face_id"))},
al AS (SELECT sid, speaker, face_id, s0 AS start_ms, e0 AS end_ms, 'unknown' AS state, 'identity_binding_unresolved' AS reason, 0.9::DOUBLE AS confidence FROM sb WHERE status IS NULL OR status IN ('candidate', 'ambiguous')
  UNION ALL SELECT sid, speaker, NULL, s0, e0, 'offscreen', 'no_bound_visible_face', 0.75 FROM sb WHERE status = 'offscreen' OR status NOT IN ('candidate', 'ambiguous') AND face_id IS NULL
  UNION ALL SELECT vis.sid, vis.speaker, b.face_id, vis.start_ms, vis.end_ms, state, reason, CASE WHEN vis.confidence IS NULL THEN b.confidence ELSE least(vis.confidence, b.confidence) END FROM vis JOIN bound b ON b.sid = vis.sid AND b.speaker = vis.speaker)
{_joined('al', 'speaker, face_id, state, reason, confidence')}"""),
    "padded_coverage": sql("active", merged("(SELECT sid, face_id, start_ms, least(1706745600000, end_ms + 200000) AS end_ms FROM active WHERE least(1706745600000, end_ms + 200000) > start_ms)", "sid, face_id")),
    "shot_coverage": sql("timed cuts", """, m AS (SELECT DISTINCT sid, cut_ms // 86400000 * 86400000 AS start_ms FROM cuts), e AS (SELECT *, lead(start_ms) OVER (PARTITION BY sid ORDER BY start_ms) AS nx FROM m),
u AS (SELECT sid, max(end_ms) + 1000 AS u FROM timed GROUP BY sid)
SELECT u.sid, row_number() OVER (PARTITION BY u.sid ORDER BY start_ms) AS shot, coalesce(start_ms, 0) AS start_ms, coalesce(nx, u) AS end_ms FROM u LEFT JOIN e ON e.sid = u.sid"""),
    "cuts_semijoin": sql("active cuts", "SELECT * FROM active a WHERE EXISTS (SELECT 1 FROM cuts c WHERE c.sid = a.sid AND c.cut_ms BETWEEN a.start_ms AND a.end_ms)"),
    "split_long_intervals": sql("speech", "SELECT sid, span_id, speaker, p AS start_ms, least(end_ms, p + 1800000) AS end_ms FROM (SELECT *, unnest(range(start_ms, end_ms, 1800000)) AS p FROM speech)"),
    "shot_transcript_topk": sql("turns scenes", "SELECT * FROM (SELECT s.sid, s.scene_id, t.turn_id, row_number() OVER (PARTITION BY s.sid, s.scene_id ORDER BY t.start_ms, t.turn_id) AS n FROM scenes s JOIN turns t ON t.sid = s.sid AND t.start_ms < s.end_ms AND s.start_ms < t.end_ms) WHERE n <= 20"),
    "resample_interpolate": sql("active", """, pts AS (SELECT sid, face_id, start_ms // 60000 * 60 AS t, min(score_u)::DOUBLE AS v FROM active GROUP BY ALL),
n AS (SELECT *, lead(t) OVER w AS nt, lead(v) OVER w AS nv, min(t) OVER (PARTITION BY sid, face_id) AS f FROM pts WINDOW w AS (PARTITION BY sid, face_id ORDER BY t)),
g AS (SELECT sid, face_id, unnest(range(lo, hi + 1, 7200)) AS g FROM (SELECT sid, face_id, min(t) AS lo, max(t) AS hi FROM pts GROUP BY ALL))
SELECT g.sid, g.face_id, g.g AS t, floor(CASE WHEN g.g = n.t THEN v ELSE v + (nv - v) * ((g.g - n.t) / (nt - n.t)) END * 1000000 + 0.5) / 1000000.0 AS v
FROM g JOIN n ON n.sid = g.sid AND n.face_id = g.face_id AND n.t <= g.g AND (n.nt > g.g OR n.nt IS NULL)"""),
    "moving_average": sql("active", "SELECT segment_id, (sum(score_u) OVER w)::BIGINT AS total, count(score_u) OVER w AS n FROM active WINDOW w AS (PARTITION BY sid, face_id ORDER BY start_ms, segment_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "run_length_postprocess": sql("active", """, a AS (SELECT *, row_number() OVER (PARTITION BY sid, face_id ORDER BY start_ms, segment_id) AS p, score_u >= 3000 AS x, count(*) OVER (PARTITION BY sid, face_id) AS n FROM active),
b AS (SELECT *, p - row_number() OVER (PARTITION BY sid, face_id, x ORDER BY p) AS r FROM a),
c AS (SELECT *, x OR (count(*) OVER w <= 2 AND min(p) OVER w > 1 AND max(p) OVER w < n) AS y FROM b WINDOW w AS (PARTITION BY sid, face_id, x, r)),
e AS (SELECT *, p - row_number() OVER (PARTITION BY sid, face_id, y ORDER BY p) AS q FROM c)
SELECT segment_id, p, y AND count(*) OVER (PARTITION BY sid, face_id, y, q) >= 3 AS active FROM e"""),
    "exclusive_winner": sql("active", "SELECT sid, start_ms // 3600000 AS bucket, segment_id, face_id, score_u FROM active QUALIFY row_number() OVER (PARTITION BY sid, start_ms // 3600000 ORDER BY score_u DESC, face_id, segment_id) = 1"),
    "activity_segments": sql("active", """SELECT sid, face_id, min(t) AS start_ms, max(t) + 40 AS end_ms, count(*) AS n, sum(score_u)::BIGINT AS score_sum FROM (
  SELECT *, sum(f) OVER (PARTITION BY sid, face_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sid, face_id ORDER BY t) <= 180 THEN 0 ELSE 1 END AS f FROM (SELECT *, start_ms // 60000 AS t FROM active WHERE score_u >= 1000)))
GROUP BY sid, face_id, g"""),
    "sliding_context_window": sql("active", """SELECT sid, e AS window_end, count(*) AS n_context, count(*) FILTER (WHERE start_ms >= e - 3600000) AS n_published, count(DISTINCT face_id) AS n_faces, e - 14400000 AS window_start
FROM (SELECT *, unnest([(start_ms // 3600000 + 1) * 3600000, (start_ms // 3600000 + 2) * 3600000, (start_ms // 3600000 + 3) * 3600000, (start_ms // 3600000 + 4) * 3600000]) AS e FROM active) GROUP BY sid, e"""),
    "speaking_state_machine": sql("active", """, o AS (SELECT DISTINCT sid, face_id, start_ms // 60000 * 40 AS t FROM active WHERE score_u >= 500),
r AS (SELECT sid, face_id, min(t) AS s, max(t) + 40 AS e FROM (SELECT *, sum(f) OVER (PARTITION BY sid, face_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sid, face_id ORDER BY t) <= 40 THEN 0 ELSE 1 END AS f FROM o)) GROUP BY sid, face_id, g),
h AS (SELECT *, sum(a) OVER (PARTITION BY sid, face_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS h FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY sid, face_id ORDER BY s) < 4000 THEN 0 ELSE 1 END AS a FROM r)),
p AS (SELECT sid, face_id, min(s) FILTER (WHERE e - s >= 80) AS started_ms, max(e) AS e FROM h GROUP BY sid, face_id, h)
SELECT sid, face_id, started_ms, CASE WHEN 1704067200000 // 60000 * 40 + 31 * 1440 * 40 - e >= 4000 THEN e END AS ended_ms FROM p WHERE started_ms IS NOT NULL"""),
    "percentile_nearest_rank": sql("timed", "SELECT sid, quantile_disc(score_u, 0.5)::DOUBLE AS p50, quantile_disc(score_u, 0.95)::DOUBLE AS p95 FROM timed GROUP BY sid"),
}
SQL = {k: v.replace("\n, ", ",\n", 1) if v.count("\n, ") else v for k, v in SQL.items()}
QUERIES = {
    f.__name__: f
    for f in (
        interval_merge, interval_merge_ids, union_duration, union_duration_padded, interval_overlap_join, overlap_bucketed, overlap_closed_end, span_face_candidates, visibility_classification, padded_coverage, shot_coverage,
        overlap_evidence, assignment_max_overlap, binding_status, binding_status_online, relabel_corrections, reconcile_fixpoint, elementary_visibility,
        merge_state_segments, cuts_semijoin, split_long_intervals, shot_transcript_topk, resample_interpolate, moving_average, run_length_postprocess,
        exclusive_winner, activity_segments, sliding_context_window, speaking_state_machine, percentile_nearest_rank,
    )
}
