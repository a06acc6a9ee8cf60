"""Vector, spatial, graph, text, evaluation and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import bhattacharyya, clamp_box, cosine, iou, logistic, r6, region, unit
from ..operators import evaluation, graph, spatial, vectors
from . import adapter as A
from .adapter import sql


def _vectors(spark, d) -> DataFrame:
    return A.table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.expr("vec_id div 25").alias("sid"), F.col("vec_id").alias("track"), "embedding", "label"
    )


def cosine_pairs(spark, d) -> DataFrame:
    pairs = vectors.similar_pairs(_vectors(spark, d), ["sid"], "track", "embedding")
    return pairs.withColumn("similarity", F.floor(F.col("similarity") * 10000 + 0.5) / F.lit(10000.0))


def centroid_weighted(spark, d) -> DataFrame:
    rows = _vectors(spark, d).withColumn("quality", F.expr("(track % 7) / 4"))
    found = vectors.weighted_centroid(rows, ["label"], "embedding", "quality", 0.25)
    return found.select("label", "dim", (F.floor(F.col("total") * 10000 + 0.5) / F.lit(10000.0)).alias("total"), r6(F.col("weight")).alias("weight"))


def representative_best(spark, d) -> DataFrame:
    rows = _vectors(spark, d).withColumn("quality", F.expr("track % 7"))
    return vectors.representatives(rows, ["label"], "track", "quality")


def cooccurrence_pairs(spark, d) -> DataFrame:
    rows = A.timed_events(spark, d).select("sid", F.col("user_id").alias("track"), "start_ms")
    return vectors.cooccurring(rows, ["sid"], "track", "start_ms", 60_000)


def iou_pairs(spark, d) -> DataFrame:
    b = A.boxes(spark, d)
    left, right = (b.select("keyframe_id", *[F.col(c).alias(f"{p}_{c}") for c in ("state", "x", "y", "w", "h")]) for p in "ab")
    over = iou(*[F.col(f"a_{c}") for c in "xywh"], *[F.col(f"b_{c}") for c in "xywh"])
    return left.join(right, "keyframe_id").where("a_state < b_state").select("keyframe_id", "a_state", "b_state", r6(over).alias("iou"))


def spatial_relations(spark, d) -> DataFrame:
    found = spatial.relations(spatial.person_states(A.boxes(spark, d)))
    return found.withColumn("confidence", r6(F.col("confidence")))


def person_regions(spark, d) -> DataFrame:
    return spatial.person_states(A.boxes(spark, d)).select("keyframe_id", "state", "horizontal_region", "vertical_region", r6(F.col("area")).alias("area"))


def region_bucket(spark, d) -> DataFrame:
    value = F.col("l_quantity") / 50
    return A.table(spark, d, "lineitem").groupBy(region(value, ["low", "mid", "high"]).alias("region")).agg(F.count(F.lit(1)).alias("n"))


def clamped_boxes(spark, d) -> DataFrame:
    b = A.boxes(spark, d)
    box = clamp_box((F.col("x") - 0.1) * 640, (F.col("y") - 0.1) * 360, F.col("w") * 640, F.col("h") * 360, 640, 360)
    return b.select("keyframe_id", "state", *[F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("left", "top", "width", "height"))])


def keyframe_select(spark, d) -> DataFrame:
    """Shots are runs of four keyframes."""
    frames = A.boxes(spark, d).groupBy("keyframe_id").agg(
        F.count(F.lit(1)).cast("double").alias("faces"), F.max("sharpness").cast("double").alias("sharpness"), F.max("h").alias("area")
    )
    shots = frames.select(F.expr("keyframe_id div 4").alias("shot"), F.col("keyframe_id").alias("frame"), "faces", "sharpness", "area")
    return spatial.select_keyframes(shots, ["shot"]).select("shot", "frame", "faces", r6(F.col("score")).alias("score"))


def candidate_frames(spark, d) -> DataFrame:
    seen = A.active(spark, d).select("sid", F.expr("start_ms div 60000").alias("frame")).distinct().withColumn("shot", F.expr("frame div 1440"))
    shots = seen.groupBy("sid", "shot").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    return spatial.candidate_frames(shots, seen, ["sid", "shot"])


def live_regions(spark, d) -> DataFrame:
    s = spatial.person_states(A.boxes(spark, d))
    return s.select("keyframe_id", "state", spatial.live_region(F.col("cx"), F.col("cy")).alias("region"))


def bigram_jaccard(spark, d) -> DataFrame:
    u = graph.units(graph.sliced(A.analyses(spark, d)))
    w = W.partitionBy("sid", "__p").orderBy("start_ms", "keyframe_id")
    found = u.select("sid", "keyframe_id", F.size("grams").alias("n_grams"), r6(F.coalesce(X.jaccard(F.lag("grams").over(w), F.col("grams")), F.lit(0.0))).alias("similarity"), "__ghost")
    return found.where("NOT __ghost").drop("__ghost")


def _groups(spark, d, *columns: str) -> DataFrame:
    return graph.merge_adjacent(A.analyses(spark, d), 0.3, ["sid", "keyframe_id", "start_ms", "end_ms", *columns])


def adjacent_scene_merge(spark, d) -> DataFrame:
    return _groups(spark, d).select("sid", "keyframe_id", "group", r6(F.col("similarity")).alias("similarity"))


def view_bridging(spark, d) -> DataFrame:
    rows = _groups(spark, d, "category").select("sid", "keyframe_id", "group", "category", (F.col("keyframe_id") % 3).alias("view"), "start_ms", "end_ms")
    return graph.bridge_views(rows, 60_000)


def graph_nodes(spark, d) -> DataFrame:
    nodes = graph.scene_nodes(_groups(spark, d, "description", "faces"))
    spell = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return nodes.select("sid", "scene_id", "label", "start_ms", "end_ms", spell("keyframes"), spell("faces"))


def present_in(spark, d) -> DataFrame:
    return graph.present_in(_groups(spark, d, "faces"))


def graph_objects(spark, d) -> DataFrame:
    return graph.object_nodes(_groups(spark, d, "keys"))


def followed_by(spark, d) -> DataFrame:
    return graph.followed_by(A.scenes(spark, d), ["start_ms"])


def topic_scene_overlap(spark, d) -> DataFrame:
    return graph.occurred_in(A.turns(spark, d), A.scenes(spark, d))


def discussed_in(spark, d) -> DataFrame:
    links = graph.occurred_in(A.turns(spark, d), A.scenes(spark, d))
    topics = A.turns(spark, d).select("sid", "turn_id", X.object_key(F.col("text")).alias("topic"))
    found = graph.discussed_in(links, topics)
    return found.withColumn("turns", F.array_join(F.col("turns").cast("array<string>"), ","))


def unlinked_turns(spark, d) -> DataFrame:
    linked = graph.occurred_in(A.turns(spark, d), A.scenes(spark, d), least_ms=1000).select("sid", "turn_id").distinct()
    return A.turns(spark, d).join(linked, ["sid", "turn_id"], "left_anti").select("sid", "turn_id", "start_ms", "end_ms")


def graph_edges(spark, d) -> DataFrame:
    e = A.timed_events(spark, d).select(
        "sid", F.concat(F.lit("person:"), (F.col("user_id") % 5).cast("string")).alias("subject"), F.col("event_type").alias("predicate"),
        F.concat(F.lit("object:"), F.expr("user_id div 50").cast("string")).alias("object"), "start_ms", "end_ms",
        F.expr("event_id % 4").cast("string").alias("description"), F.expr("event_id % 3").cast("string").alias("basis"),
    )
    found = graph.interactions(e)
    return found.withColumns({"descriptions": F.array_join(F.array_sort("descriptions"), ","), "bases": F.array_join("bases", ",")})


#: Predicates of the edges of the event graph: each of the mapped ones, and one that goes by its source.
PREDICATES = (*graph.EVENT_TYPES, "looks_at")


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    e = A.timed_events(spark, d)
    day = F.expr("start_ms div 86400000")
    scenes = e.groupBy("sid", day.alias("k")).agg(F.min("start_ms").alias("start_ms"))
    scenes = scenes.select("sid", F.col("k").alias("n"), F.concat(F.lit("scene:"), F.col("k").cast("string")).alias("id"), F.lit("scene").alias("type"), "start_ms")
    people = e.groupBy("sid", "user_id").agg(F.min("start_ms").alias("start_ms"))
    people = people.select("sid", F.col("user_id").alias("n"), F.concat(F.lit("person:"), F.col("user_id").cast("string")).alias("id"), F.lit("person").alias("type"), "start_ms")
    topics = e.groupBy("sid", "event_type").agg(F.min("start_ms").alias("start_ms"))
    topics = topics.select("sid", F.char_length("event_type").cast("bigint").alias("n"), F.concat(F.lit("topic:"), "event_type").alias("id"), F.lit("topic").alias("type"), "start_ms")
    predicate = F.element_at(F.array(*map(F.lit, PREDICATES)), (F.col("event_id") % len(PREDICATES) + 1).cast("int"))
    person = F.concat(F.lit("person:"), F.col("user_id").cast("string"))
    edges = e.select(
        "sid", F.col("event_id").alias("n"), F.concat(F.lit("edge:"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("scene:"), day.cast("string"))).otherwise(person).alias("source"),
        F.concat(F.lit("scene:"), day.cast("string")).alias("target"), predicate.alias("predicate"), "start_ms",
    )
    return scenes.unionByName(people).unionByName(topics), edges


def graph_events(spark, d) -> DataFrame:
    return graph.graph_events(*_graph(spark, d))


def replay_snapshot(spark, d) -> DataFrame:
    return graph.snapshot(graph.graph_events(*_graph(spark, d)), 1705000000000, 25)


def replay_reveals(spark, d) -> DataFrame:
    return graph.revealed(graph.graph_events(*_graph(spark, d)), 1705000000000)


def replay_scene(spark, d) -> DataFrame:
    return graph.current_scene(A.scenes(spark, d), 5000)


def graph_statistics(spark, d) -> DataFrame:
    nodes, edges = _graph(spark, d)
    by_type = nodes.groupBy("sid").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") == "scene").alias("scenes"))
    by_edge = edges.groupBy("sid").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("predicate") == "speaking").alias("speaking"), F.count_distinct("source").alias("sources")
    )
    return by_type.join(by_edge, "sid", "left").fillna(0)


def _labelled(spark, d) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), " "))
    docs = A.table(spark, d, "documents").where("text IS NOT NULL").select("lang", "doc_id", words.alias("predicted"))
    long = F.filter("predicted", lambda x: F.char_length(x) > 2)
    return docs.withColumn("expected", F.when(F.size("predicted") > 5, F.concat(long, F.array(F.col("lang")))))


def set_metrics_prf(spark, d) -> DataFrame:
    return evaluation.set_metrics(_labelled(spark, d), "expected", "predicted", ["lang"])


def identity_accuracy(spark, d) -> DataFrame:
    l = A.table(spark, d, "labels").select("doc_id", F.nullif("quality", F.lit(2)).alias("expected"), F.col("toxic").alias("predicted"))  # noqa: E741
    return evaluation.accuracy(l.join(A.table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "expected", "predicted", ["lang"])


def macro_score(spark, d) -> DataFrame:
    f1 = set_metrics_prf(spark, d).select("lang", "f1")
    acc = identity_accuracy(spark, d).select("lang", r6(F.col("right") / F.col("n")).alias("identity"))
    both = f1.join(acc, "lang", "full_outer")
    return both.select("lang", evaluation.macro([F.col("f1"), F.col("identity"), F.lit(None).cast("double")]).alias("macro"))


def validation_violations(spark, d) -> DataFrame:
    events, orders, lines = (A.table(spark, d, t) for t in ("events", "orders", "lineitem"))
    spans = A.speech(spark, d)
    return evaluation.violations(
        evaluation.not_unique(events, ["event_id"], "event_unique"), evaluation.not_unique(lines, ["l_orderkey", "l_linenumber"], "line_unique"),
        evaluation.dangling(lines.select(F.col("l_orderkey").alias("o_orderkey")), orders, ["o_orderkey"], "o_orderkey", "line_has_order"),
        evaluation.out_of_range(events, (F.col("value") < 0.05) | (F.col("value") > 400), "event_id", "value_range"),
        evaluation.overlapping(spans, ["sid", "speaker"], "span_id", "span_overlap"), evaluation.not_tiling(A.scenes(spark, d), ["sid"], "scene_id", "scene_tiling"),
    )


def text_functions(spark, d) -> DataFrame:
    t = F.col("text")
    return A.table(spark, d, "documents").where("text IS NOT NULL").select(
        "doc_id", X.letters(t).alias("letters"), X.object_key(t).alias("object_key"), X.evaluation_label(F.concat(t, F.lit("_Ab  c"))).alias("label"),
        X.canonical_label(F.when(F.col("doc_id") % 2 == 0, F.lit(" Potted-Plant ")).otherwise(t)).alias("canonical"),
        X.content_id("evidence:", F.col("lang"), F.col("source"), t).alias("evidence_id"),
    )


def joined_texts(spark, d) -> DataFrame:
    w = A.turns(spark, d).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "text"))), lambda x: x["text"]).alias("parts"))
    return w.select("sid", F.sha2(X.join_texts(F.col("parts")), 256).alias("sha256"))


def relation_keys(spark, d) -> DataFrame:
    e = A.timed_events(spark, d)
    p = F.expr("CASE event_type WHEN 'click' THEN 'co_visible_with' WHEN 'view' THEN 'visually_close_to' ELSE 'left_of' END")
    key = X.relation_key(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")), p, F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))))
    return e.select(key.alias("r")).groupBy(F.col("r.subject").alias("subject"), F.col("r.predicate").alias("predicate"), F.col("r.object").alias("object")).agg(F.count(F.lit(1)).alias("n"))


def unit_vectors(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    r4 = lambda x: F.floor(x * 10000 + 0.5) / F.lit(10000.0)
    axis = F.transform("embedding", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return v.select("track", r4(cosine(F.col("embedding"), axis)).alias("c"), F.posexplode(unit(F.col("embedding"))).alias("dim", "u")).withColumn("u", r4(F.col("u")))


def histogram_distance(spark, d) -> DataFrame:
    v = _vectors(spark, d).select("sid", "track", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("histogram"))
    w = W.partitionBy("sid").orderBy("track")
    marked = v.withColumn("distance", bhattacharyya(F.lag("histogram").over(w), F.col("histogram")))
    return marked.where("distance IS NOT NULL").select("sid", "track", (F.floor(F.col("distance") * 10000 + 0.5) / F.lit(10000.0)).alias("distance"))


def logistic_scores(spark, d) -> DataFrame:
    s = logistic((F.col("score_u") - 5000) / 1000.0)
    return A.timed_events(spark, d).select("event_id", (F.floor(s * 100000 + 0.5) / F.lit(100000.0)).alias("probability"))


def track_assignment(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    rows = v.select(
        "sid", F.expr("(track % 25) div 3").alias("frame"), F.expr("track % 3").alias("det"),
        F.expr("array(cast(label * 10 AS double), 10D, 20D, 20D)").alias("box"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return vectors.track(rows, max_gap=4)


def agglomerative_clusters(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    tracks = v.select("sid", "track", (F.col("track") * 100).alias("start_ms"), F.lit(1.0).alias("weight"), F.col("embedding").cast("array<double>").alias("embedding"))
    apart = v.where("track % 25 < 24").select("sid", F.col("track").alias("a"), (F.col("track") + 1).alias("b")).where("a % 2 = 0")
    return vectors.agglomerate(tracks, apart, 0.3)


def leader_clusters(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    rows = v.select(F.col("sid").cast("string").alias("sid"), F.col("track").alias("item"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("histogram"))
    return vectors.leaders(rows, 0.35)


def strongest_cuts(spark, d) -> DataFrame:
    return vectors.strongest_cuts(A.active(spark, d), ["sid", "face_id"], "start_ms", "score_u", 1_800_000)


def bridged_fragments(spark, d) -> DataFrame:
    b = A.boxes(spark, d)
    obs = b.select(F.expr("keyframe_id div 60").alias("sid"), F.expr("CASE WHEN (keyframe_id div 3) % 7 = 0 THEN keyframe_id ELSE state END").alias("track"), F.col("keyframe_id").alias("t"), "x", "y", "w", "h")
    obs = obs.groupBy("sid", "track", "t").agg(*[F.min(c).alias(c) for c in "xywh"])
    return vectors.bridged_fragments(obs, 2).withColumn("score", r6(F.col("score")))


_R4 = "floor({} * 10000 + 0.5) / 10000.0"
_VEC = "vec AS (SELECT vec_id // 25 AS sid, vec_id AS track, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"
_IOU = """CASE WHEN a.w * a.h + b.w * b.h - {i} <= 0 THEN 0.0 ELSE {i} / (a.w * a.h + b.w * b.h - {i}) END""".format(
    i="(greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
)
_R6 = "floor({} * 1000000 + 0.5) / 1000000.0"
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+".replace("{", "{{").replace("}", "}}")
_KEY = "replace(trim(regexp_replace(lower({}), '" + _SPACE + "', ' ', 'g'), ' '), ' ', '_')"
_LETTERS = r"regexp_replace(lower(description), '[^\p{L}\p{N}]', '', 'g')"
_UNITS = f"""u AS (SELECT *, CASE WHEN len(t) >= 2 THEN list_distinct(list_transform(list_zip(t[1:len(t) - 1], t[2:len(t)]), lambda z: z[1] || z[2])) WHEN len(t) = 1 THEN t ELSE [] END AS grams
FROM (SELECT *, list_filter(string_split({_LETTERS}, ''), lambda c: c <> '') AS t, list_distinct(list_transform(objects, lambda o: {_KEY.format('o')})) AS keys FROM analyses))"""
_J = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_GROUPS = f"""{_UNITS},
l AS (SELECT *, lag(category) OVER w AS pc, lag(grams) OVER w AS pg, lag(keys) OVER w AS pk, lag(faces) OVER w AS pf FROM u WINDOW w AS (PARTITION BY sid ORDER BY start_ms, keyframe_id)),
s AS (SELECT *, CASE WHEN pc IS NULL THEN 0.0 WHEN pc = category THEN 0.55::DOUBLE * ({_J.format("pg", "grams")}) + 0.3::DOUBLE * ({_J.format("pk", "keys")}) + 0.15::DOUBLE * ({_J.format("pf", "faces")}) ELSE 0.0 END AS similarity FROM l),
g AS (SELECT *, sum(CASE WHEN pc = category AND similarity >= 0.3 THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY start_ms, keyframe_id ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM s)"""
_GRAPH = """nodes AS (SELECT sid, start_ms // 86400000 AS n, 'scene:' || (start_ms // 86400000)::VARCHAR AS id, 'scene' AS type, min(start_ms) AS start_ms FROM timed GROUP BY ALL
  UNION ALL SELECT sid, user_id, 'person:' || user_id::VARCHAR, 'person', min(start_ms) FROM timed GROUP BY ALL
  UNION ALL SELECT sid, length(event_type), 'topic:' || event_type, 'topic', min(start_ms) FROM timed GROUP BY sid, event_type),
edges AS (SELECT sid, event_id AS n, 'edge:' || event_id::VARCHAR AS id, CASE WHEN event_type = 'signup' THEN 'scene:' || (start_ms // 86400000)::VARCHAR ELSE 'person:' || user_id::VARCHAR END AS source,
  'scene:' || (start_ms // 86400000)::VARCHAR AS target,
  ['present_in', 'contains', 'speaking', 'identity_candidate', 'expresses', 'about', 'has_intent', 'occurred_in', 'discussed_in', 'followed_by', 'looks_at'][event_id % 11 + 1] AS predicate, start_ms FROM timed)"""
_EVENTS = f"""{_GRAPH}, ev AS (SELECT sid, t, kind, type, subject, object, ref, row_number() OVER (PARTITION BY sid ORDER BY t, kind, n) AS sequence FROM (
  SELECT sid, start_ms AS t, 0 AS kind, n, 'scene_changed' AS type, id AS subject, NULL AS object, id AS ref FROM nodes WHERE type = 'scene'
  UNION ALL SELECT sid, start_ms, 1, n, CASE WHEN predicate = 'present_in' THEN 'person_seen' WHEN predicate = 'contains' THEN 'object_detected' WHEN predicate = 'speaking' THEN 'person_speaking'
    WHEN predicate = 'identity_candidate' THEN 'identity_candidate' WHEN predicate IN ('expresses', 'about', 'has_intent', 'occurred_in', 'discussed_in') THEN 'dialogue_linked' WHEN predicate = 'followed_by' THEN 'relation_observed'
    WHEN EXISTS (SELECT 1 FROM nodes p WHERE p.sid = g.sid AND p.id = g.source AND p.type IN ('person', 'visual_identity')) THEN 'interaction_detected' ELSE 'relation_observed' END, source, target, id FROM edges g
  UNION ALL SELECT sid, start_ms, 2, n, 'node_available', id, NULL, id FROM nodes x WHERE type <> 'scene' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.sid = x.sid AND (e.source = x.id OR e.target = x.id))))"""
_LINKS = f"""links AS (SELECT sid, turn_id, scene_id, s AS overlap_start, e AS overlap_end, e - s AS overlap_ms, {_R6.format("((e - s) / greatest(1, t1 - t0))")} AS turn_coverage,
  {_R6.format("((e - s) / greatest(1, c1 - c0))")} AS scene_coverage FROM (SELECT t.sid, t.turn_id, c.scene_id, greatest(t.start_ms, c.start_ms) AS s, least(t.end_ms, c.end_ms) AS e,
  t.start_ms AS t0, t.end_ms AS t1, c.start_ms AS c0, c.end_ms AS c1 FROM turns t JOIN {{scenes}} c ON c.sid = t.sid) WHERE e - s >= 120)"""
_PRF = f"""lab AS (SELECT lang, doc_id, CASE WHEN len(p) > 5 THEN list_distinct(list_append(list_filter(p, lambda x: length(x) > 2), lang)) END AS e, p FROM (
  SELECT lang, doc_id, list_distinct(string_split(lower(text), ' ')) AS p FROM documents WHERE text IS NOT NULL)),
cnt AS (SELECT lang, count(*) AS frames, sum(len(list_intersect(e, p)))::BIGINT AS tp, sum(len(p) - len(list_intersect(e, p)))::BIGINT AS fp, sum(len(e) - len(list_intersect(e, p)))::BIGINT AS fn FROM lab WHERE e IS NOT NULL GROUP BY lang),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM cnt),
prf AS (SELECT lang, frames, tp, fp, fn, {_R6.format("p")} AS precision, {_R6.format("r")} AS recall, {_R6.format("(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END)")} AS f1 FROM pr)"""
_ACC = """acc AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NOT DISTINCT FROM toxic) AS "right" FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang)"""
_BOXREL = f"""ps AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM boxes), o AS (SELECT *, row_number() OVER (PARTITION BY keyframe_id ORDER BY cx, state) AS n FROM ps),
q AS (SELECT a.keyframe_id, a.state AS s, b.state AS o, least(a.confidence, b.confidence) AS base, b.cx - a.cx AS dx, b.cy - a.cy AS dy, {_IOU} AS i FROM o a JOIN o b ON a.keyframe_id = b.keyframe_id AND a.n < b.n),
d AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM q)"""

SQL = {
    "cosine_pairs": f"WITH {_VEC} SELECT a.sid, a.track AS a, b.track AS b, {_R4.format('list_cosine_similarity(a.e, b.e)')} AS similarity FROM vec a JOIN vec b ON a.sid = b.sid AND a.track < b.track",
    "centroid_weighted": f"WITH {_VEC}, p AS (SELECT label, unnest(range(0, len(e))) AS dim, unnest(e) AS v, greatest(0.25, (track % 7) / 4) AS w FROM vec) SELECT label, dim, {_R4.format('sum(v * w)')} AS total, {_R6.format('sum(w)')} AS weight FROM p GROUP BY label, dim",
    "representative_best": f"WITH {_VEC} SELECT label, track AS representative, track % 7 AS quality FROM vec QUALIFY row_number() OVER (PARTITION BY label ORDER BY track % 7 DESC, track) = 1",
    "cooccurrence_pairs": sql("timed", "SELECT DISTINCT a.sid, a.user_id AS a, b.user_id AS b FROM timed a JOIN timed b ON a.sid = b.sid AND a.user_id < b.user_id AND abs(a.start_ms - b.start_ms) <= 60000"),
    "iou_pairs": sql("boxes", f"SELECT a.keyframe_id, a.state AS a_state, b.state AS b_state, {_R6.format(f'({_IOU})')} AS iou FROM boxes a JOIN boxes b ON a.keyframe_id = b.keyframe_id AND a.state < b.state"),
    "spatial_relations": sql("boxes", f""", {_BOXREL} SELECT keyframe_id, predicate, subject, object, {_R6.format("greatest(0.0::DOUBLE, least(1.0::DOUBLE, m))")} AS confidence FROM (
SELECT keyframe_id, 'co_visible_with' AS predicate, s AS subject, o AS object, base AS m FROM d
UNION ALL SELECT keyframe_id, 'left_of', s, o, base * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, abs(dx) / 0.5::DOUBLE)) FROM d WHERE abs(dx) >= 0.08::DOUBLE
UNION ALL SELECT keyframe_id, 'above', CASE WHEN dy < 0 THEN o ELSE s END, CASE WHEN dy < 0 THEN s ELSE o END, base * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, abs(dy) / 0.5::DOUBLE)) FROM d WHERE abs(dy) >= 0.08::DOUBLE
UNION ALL SELECT keyframe_id, 'visually_close_to', s, o, base * (0.5::DOUBLE + 0.5::DOUBLE * (1 - dist / 0.35::DOUBLE)) FROM d WHERE dist <= 0.35::DOUBLE UNION ALL SELECT keyframe_id, 'overlaps_in_image', s, o, base * i FROM d WHERE i >= 0.1::DOUBLE)"""),
    "person_regions": sql("boxes", f"SELECT keyframe_id, state, ['left', 'center', 'right'][least(2, floor((x + w / 2) * 3)::INT) + 1] AS horizontal_region, ['upper', 'middle', 'lower'][least(2, floor((y + h / 2) * 3)::INT) + 1] AS vertical_region, {_R6.format('(w * h)')} AS area FROM boxes"),
    "region_bucket": "SELECT ['low', 'mid', 'high'][least(2, floor(l_quantity / 50 * 3)::INT) + 1] AS region, count(*) AS n FROM lineitem GROUP BY 1",
    "clamped_boxes": sql("boxes", """, r AS (SELECT keyframe_id, state, (x - 0.1::DOUBLE) * 640 AS x, (y - 0.1::DOUBLE) * 360 AS y, w * 640 AS w, h * 360 AS h FROM boxes),
c AS (SELECT *, least(639, greatest(0, round_even(x, 0)::INT)) AS l, least(359, greatest(0, round_even(y, 0)::INT)) AS t FROM r)
SELECT keyframe_id, state, l AS "left", t AS top, least(640, greatest(l + 1, round_even(x + w, 0)::INT)) - l AS width, least(360, greatest(t + 1, round_even(y + h, 0)::INT)) - t AS height FROM c"""),
    "keyframe_select": sql("boxes", f""", f AS (SELECT keyframe_id // 4 AS shot, keyframe_id AS frame, count(*)::DOUBLE AS faces, max(sharpness)::DOUBLE AS sharpness, max(h) AS area FROM boxes GROUP BY keyframe_id),
n AS (SELECT *, 0.45::DOUBLE * (CASE WHEN max(sharpness) OVER w <= min(sharpness) OVER w THEN 1.0 ELSE (sharpness - min(sharpness) OVER w) / (max(sharpness) OVER w - min(sharpness) OVER w) END)
 + 0.35::DOUBLE * (CASE WHEN max(faces) OVER w <= min(faces) OVER w THEN 1.0 ELSE (faces - min(faces) OVER w) / (max(faces) OVER w - min(faces) OVER w) END)
 + 0.2::DOUBLE * (CASE WHEN max(area) OVER w <= min(area) OVER w THEN 1.0 ELSE (area - min(area) OVER w) / (max(area) OVER w - min(area) OVER w) END) AS score FROM f WINDOW w AS (PARTITION BY shot))
SELECT shot, frame, faces, {_R6.format("score")} AS score FROM n QUALIFY row_number() OVER (PARTITION BY shot ORDER BY faces DESC, score DESC, frame) = 1"""),
    "candidate_frames": sql("active", """, seen AS (SELECT DISTINCT sid, start_ms // 60000 // 1440 AS shot, start_ms // 60000 AS frame FROM active), sh AS (SELECT sid, shot, min(frame) AS f, max(frame) AS l FROM seen GROUP BY ALL),
tg AS (SELECT DISTINCT sid, shot, round_even(f + p * (l - f), 0)::BIGINT AS target FROM (SELECT *, unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS p FROM sh))
SELECT sid, shot, target AS frame FROM tg UNION SELECT sid, shot, frame FROM (SELECT t.sid, t.shot, s.frame, row_number() OVER (PARTITION BY t.sid, t.shot, t.target ORDER BY abs(s.frame - t.target), s.frame) AS n FROM tg t JOIN seen s ON s.sid = t.sid AND s.shot = t.shot) WHERE n = 1"""),
    "live_regions": sql("boxes", """SELECT keyframe_id, state, (CASE WHEN y + h / 2 < 1 / 3 THEN 'top' WHEN y + h / 2 > 2 / 3 THEN 'bottom' ELSE 'center' END) || '-' || (CASE WHEN x + w / 2 < 1 / 3 THEN 'left' WHEN x + w / 2 > 2 / 3 THEN 'right' ELSE 'center' END) AS region FROM boxes"""),
    "bigram_jaccard": sql("analyses", f", {_UNITS}, l AS (SELECT *, lag(grams) OVER (PARTITION BY sid ORDER BY start_ms, keyframe_id) AS pg FROM u) SELECT sid, keyframe_id, len(grams) AS n_grams, {_R6.format('(CASE WHEN pg IS NULL THEN 0.0 ELSE ' + _J.format('pg', 'grams') + ' END)')} AS similarity FROM l"),
    "adjacent_scene_merge": sql("analyses", f', {_GROUPS} SELECT sid, keyframe_id, grp AS "group", {_R6.format("similarity")} AS similarity FROM g'),
    "graph_nodes": sql("analyses", f""", {_GROUPS}, f AS (SELECT sid, grp, string_agg(face, ',' ORDER BY k) AS faces FROM (SELECT sid, grp, face, min((start_ms, keyframe_id)) AS k FROM (SELECT *, unnest(faces) AS face FROM g) GROUP BY ALL) GROUP BY ALL)
SELECT g.sid, g.grp AS scene_id, arg_min(description, (start_ms, keyframe_id)) AS label, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(keyframe_id::VARCHAR, ',' ORDER BY start_ms, keyframe_id) AS keyframes, any_value(f.faces) AS faces
FROM g JOIN f ON f.sid = g.sid AND f.grp = g.grp GROUP BY g.sid, g.grp"""),
    "present_in": sql("analyses", f", {_GROUPS} SELECT sid, grp AS scene_id, face AS face_id, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, unnest(faces) AS face FROM g) GROUP BY ALL"),
    "graph_objects": sql("analyses", f", {_GROUPS} SELECT sid, grp AS scene_id, k AS object_key, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, unnest(keys) AS k FROM g) WHERE k <> '' GROUP BY ALL"),
    "followed_by": sql("scenes", "SELECT * FROM (SELECT sid, scene_id AS source, lead(scene_id) OVER w AS target, end_ms AS start_ms, lead(start_ms) OVER w AS end_ms FROM scenes WINDOW w AS (PARTITION BY sid ORDER BY start_ms)) WHERE target IS NOT NULL"),
    "topic_scene_overlap": sql("turns scenes", f", {_LINKS.format(scenes='scenes')} SELECT * FROM links"),
    "discussed_in": sql("turns scenes", f", {_LINKS.format(scenes='scenes')}" + f""", tp AS (SELECT sid, turn_id, {_KEY.format('text')} AS topic FROM turns)
SELECT l.sid, topic, scene_id, sum(overlap_ms)::BIGINT AS overlap_ms, min(overlap_start) AS start_ms, max(overlap_end) AS end_ms, string_agg(l.turn_id::VARCHAR, ',' ORDER BY l.turn_id) AS turns
FROM links l JOIN tp ON tp.sid = l.sid AND tp.turn_id = l.turn_id GROUP BY ALL"""),
    "unlinked_turns": sql("turns scenes", f", {_LINKS.format(scenes='scenes')} SELECT sid, turn_id, start_ms, end_ms FROM turns t WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.overlap_ms >= 1000 AND l.sid = t.sid AND l.turn_id = t.turn_id)"),
    "graph_edges": sql("timed", """SELECT sid, 'person:' || (user_id % 5)::VARCHAR AS subject, event_type AS predicate, 'object:' || (user_id // 50)::VARCHAR AS object, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
string_agg(DISTINCT (event_id % 4)::VARCHAR, ',' ORDER BY (event_id % 4)::VARCHAR) AS descriptions, string_agg(DISTINCT (event_id % 3)::VARCHAR, ',' ORDER BY (event_id % 3)::VARCHAR) AS bases FROM timed GROUP BY 1, 2, 3, 4"""),
    "graph_events": sql("timed", f", {_EVENTS} SELECT * FROM ev"),
    "replay_snapshot": sql("timed", f", {_EVENTS} SELECT *, count(*) OVER (PARTITION BY sid) AS n_past FROM ev WHERE t <= 1705000000000 QUALIFY row_number() OVER (PARTITION BY sid ORDER BY sequence DESC) <= 25"),
    "replay_reveals": sql("timed", f", {_EVENTS} SELECT DISTINCT sid, 'node' AS what, subject AS id FROM ev WHERE t <= 1705000000000 UNION SELECT sid, 'node', object FROM ev WHERE t <= 1705000000000 AND object IS NOT NULL UNION SELECT sid, 'edge', ref FROM ev WHERE t <= 1705000000000 AND kind = 1"),
    "replay_scene": sql("scenes", "SELECT sid, arg_max(scene_id, (start_ms, scene_id)) AS scene_id FROM (SELECT *, max(end_ms) OVER (PARTITION BY sid) AS l FROM scenes) WHERE start_ms <= 5000 AND (end_ms > 5000 OR (end_ms = 5000 AND l = 5000)) GROUP BY sid"),
    "graph_statistics": sql("timed", f", {_GRAPH} SELECT n.sid, n.nodes, n.scenes, coalesce(e.edges, 0) AS edges, coalesce(e.speaking, 0) AS speaking, coalesce(e.sources, 0) AS sources FROM (SELECT sid, count(*) AS nodes, count(*) FILTER (WHERE type = 'scene') AS scenes FROM nodes GROUP BY sid) n LEFT JOIN (SELECT sid, count(*) AS edges, count(*) FILTER (WHERE predicate = 'speaking') AS speaking, count(DISTINCT source) AS sources FROM edges GROUP BY sid) e ON e.sid = n.sid"),
    "set_metrics_prf": f"WITH {_PRF} SELECT * FROM prf",
    "identity_accuracy": f"WITH {_ACC} SELECT * FROM acc",
    "macro_score": f"WITH {_PRF}, {_ACC}, i AS (SELECT lang, {_R6.format('(\"right\" / n)')} AS identity FROM acc) SELECT coalesce(prf.lang, i.lang) AS lang, {_R6.format('((coalesce(f1, 0.0) + coalesce(identity, 0.0)) / ((f1 IS NOT NULL)::INT + (identity IS NOT NULL)::INT))')} AS macro FROM prf FULL JOIN i ON i.lang = prf.lang",
    "validation_violations": sql("speech scenes", """SELECT 'event_unique' AS rule, event_id::VARCHAR AS entity FROM events GROUP BY event_id HAVING count(*) > 1
UNION ALL SELECT 'line_unique', l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'line_has_order', l_orderkey::VARCHAR FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'value_range', event_id::VARCHAR FROM events WHERE value < 0.05 OR value > 400
UNION ALL SELECT 'span_overlap', span_id::VARCHAR FROM (SELECT *, max(end_ms) OVER (PARTITION BY sid, speaker ORDER BY start_ms, end_ms, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM speech) WHERE start_ms < m
UNION ALL SELECT 'scene_tiling', scene_id::VARCHAR FROM (SELECT *, lag(end_ms) OVER (PARTITION BY sid ORDER BY start_ms, scene_id) AS p FROM scenes) WHERE start_ms <> p"""),
    "text_functions": rf"""WITH t AS (SELECT doc_id, lang, source, text AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN ' Potted-Plant ' ELSE t END AS k FROM t)
SELECT doc_id, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]', '', 'g') AS letters, {_KEY.format('t')} AS object_key,
trim(regexp_replace(lower(replace(t || '_Ab  c', '_', ' ')), '{_SPACE.replace("{{", "{").replace("}}", "}")}', ' ', 'g'), ' ') AS label,
CASE WHEN doc_id % 2 = 0 THEN 'plant' ELSE {_KEY.format("replace(k, '-', ' ')")} END AS canonical,
'evidence:' || substring(sha256(lang || chr(31) || source || chr(31) || t), 1, 16) AS evidence_id FROM c""",
    "joined_texts": sql("turns", """SELECT sid, sha256(list_reduce(list(text ORDER BY turn_id, text), lambda a, b: a || CASE WHEN regexp_matches(a, '[A-Za-z0-9]\\z') AND regexp_matches(b, '\\A[A-Za-z0-9]') THEN ' ' ELSE '' END || b)) AS sha256 FROM turns GROUP BY sid"""),
    "strongest_cuts": "WITH RECURSIVE" + sql("active", """, o AS (SELECT sid, face_id, start_ms AS t, score_u AS s, row_number() OVER (PARTITION BY sid, face_id ORDER BY start_ms, score_u) AS n, count(*) OVER (PARTITION BY sid, face_id) AS m FROM active),
r AS (SELECT sid, face_id, n, m, t AS lt, s AS ls, NULL::BIGINT AS et, NULL::BIGINT AS es FROM o WHERE n = 1
  UNION ALL SELECT o.sid, o.face_id, o.n, o.m, CASE WHEN o.t - lt > 1800000 OR o.s > ls THEN o.t ELSE lt END, CASE WHEN o.t - lt > 1800000 OR o.s > ls THEN o.s ELSE ls END,
    CASE WHEN o.t - lt > 1800000 THEN lt END, CASE WHEN o.t - lt > 1800000 THEN ls END FROM r JOIN o ON o.sid = r.sid AND o.face_id = r.face_id AND o.n = r.n + 1)
SELECT sid, face_id, et AS start_ms, es AS score_u FROM r WHERE et IS NOT NULL UNION ALL SELECT sid, face_id, lt, ls FROM r WHERE n = m""").removeprefix("WITH"),
    "bridged_fragments": sql("boxes", f""", ob AS (SELECT sid, track, t, min(x) AS x, min(y) AS y, min(w) AS w, min(h) AS h FROM (SELECT keyframe_id // 60 AS sid, CASE WHEN (keyframe_id // 3) % 7 = 0 THEN keyframe_id ELSE state END AS track, keyframe_id AS t, x, y, w, h FROM boxes) GROUP BY ALL),
sz AS (SELECT sid, track, count(*) AS n, min(t) AS lo, max(t) AS hi FROM ob GROUP BY sid, track),
fr AS (SELECT s.*, a.x AS x0, a.y AS y0, a.w AS w0, a.h AS h0, b.x AS x1, b.y AS y1, b.w AS w1, b.h AS h1 FROM sz s JOIN ob a ON a.sid = s.sid AND a.track = s.track AND a.t = s.lo JOIN ob b ON b.sid = s.sid AND b.track = s.track AND b.t = s.hi WHERE s.n <= 5),
met AS (SELECT f.sid, f.track AS fragment, g.track AS target, max(o.t) FILTER (WHERE o.t < f.lo) AS tb, min(o.t) FILTER (WHERE o.t > f.hi) AS ta FROM fr f JOIN sz g ON g.sid = f.sid AND g.n >= 6 JOIN ob o ON o.sid = g.sid AND o.track = g.track
  AND o.t BETWEEN f.lo - 4 AND f.hi + 4 GROUP BY ALL),
sd AS (SELECT m.sid, m.fragment, m.target, {_IOU.replace('a.', 'p.').replace('b.', 'z.')} AS i0, {_IOU.replace('a.', 'q.').replace('b.', 'v.')} AS i1 FROM met m JOIN fr f ON f.sid = m.sid AND f.track = m.fragment
  JOIN ob p ON p.sid = m.sid AND p.track = m.target AND p.t = m.tb JOIN ob q ON q.sid = m.sid AND q.track = m.target AND q.t = m.ta
  JOIN ob z ON z.sid = m.sid AND z.track = m.fragment AND z.t = f.lo JOIN ob v ON v.sid = m.sid AND v.track = m.fragment AND v.t = f.hi)
SELECT sid, fragment, target, {_R6.format("least(i0, i1)")} AS score FROM sd WHERE least(i0, i1) >= 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY sid, fragment ORDER BY least(i0, i1) DESC, target) = 1"""),
    "relation_keys": sql("timed", """, r AS (SELECT 'p' || (user_id % 4)::VARCHAR AS s, CASE event_type WHEN 'click' THEN 'co_visible_with' WHEN 'view' THEN 'visually_close_to' ELSE 'left_of' END AS p, CASE WHEN event_id % 9 <> 0 THEN 'p' || (event_id % 4)::VARCHAR ELSE '' END AS o FROM timed)
SELECT CASE WHEN p <> 'left_of' AND o < s THEN o ELSE s END AS subject, p AS predicate, CASE WHEN p <> 'left_of' AND o < s THEN s ELSE o END AS object, count(*) AS n FROM r GROUP BY 1, 2, 3"""),
    "unit_vectors": f"WITH {_VEC}, n AS (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS n FROM vec) SELECT track, (i - 1)::INT AS dim, {_R4.format('(e[1] / n)')} AS c, {_R4.format('(e[i] / n)')} AS u FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM n)",
    "histogram_distance": f"WITH {_VEC}, h AS (SELECT sid, track, list_transform(e, lambda x: abs(x)) AS h, lag(list_transform(e, lambda x: abs(x))) OVER (PARTITION BY sid ORDER BY track) AS p FROM vec) SELECT sid, track, {_R4.format('sqrt(greatest(0.0, 1 - list_sum(list_transform(list_zip(h, p), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(h) * list_sum(p))))')} AS distance FROM h WHERE p IS NOT NULL",
    "view_bridging": "WITH RECURSIVE" + sql("analyses", f""", {_GROUPS},
gs AS (SELECT sid, grp, {{'cat': first(category ORDER BY start_ms, keyframe_id), 'n': count(*), 'ms': sum(end_ms - start_ms)::BIGINT, 'views': list(keyframe_id % 3), 'ids': list(keyframe_id ORDER BY start_ms, keyframe_id)}} AS x FROM g GROUP BY sid, grp),
b AS (SELECT sid, list(x ORDER BY grp) AS held, 1::BIGINT AS i FROM gs GROUP BY sid
  UNION ALL SELECT sid, CASE WHEN ok THEN list_concat(list_concat(held[:i - 1], [{{'cat': l.cat, 'n': l.n + m.n + r.n, 'ms': l.ms + m.ms + r.ms, 'views': list_concat(list_concat(l.views, m.views), r.views), 'ids': list_concat(list_concat(l.ids, m.ids), r.ids)}}]), held[i + 3:]) ELSE held END,
    CASE WHEN ok THEN greatest(1, i - 2) ELSE i + 1 END
  FROM (SELECT *, l.cat IS NOT DISTINCT FROM m.cat AND m.cat IS NOT DISTINCT FROM r.cat AND m.n <= 2 AND m.ms <= 60000 AND list_has_any(l.views, r.views) AS ok
    FROM (SELECT *, held[i] AS l, held[i + 1] AS m, held[i + 2] AS r FROM b WHERE i + 2 <= len(held)))),
o AS (SELECT sid, held, unnest(range(1, len(held) + 1)) AS "group" FROM b WHERE i + 2 > len(held))
SELECT sid, unnest(held["group"].ids) AS keyframe_id, "group" FROM o""").removeprefix("WITH"),
    "leader_clusters": f"""WITH RECURSIVE {_VEC}, h AS (SELECT sid::VARCHAR AS sid, track AS item, list_transform(e, lambda x: abs(x)) AS h, row_number() OVER (PARTITION BY sid ORDER BY track) AS n FROM vec),
r AS (SELECT sid, n, item, [{{'item': item, 'h': h}}] AS kept, item AS leader, 0.0::DOUBLE AS distance FROM h WHERE n = 1
  UNION ALL SELECT sid, n, item, CASE WHEN best.d <= 0.35 THEN kept ELSE list_append(kept, {{'item': item, 'h': h}}) END, CASE WHEN best.d <= 0.35 THEN best.item ELSE item END, CASE WHEN best.d <= 0.35 THEN best.d ELSE 0.0 END
  FROM (SELECT o.sid, o.n, o.item, o.h, kept, list_sort(list_transform(kept, lambda k: {{'d': sqrt(greatest(0.0, 1 - list_sum(list_transform(list_zip(o.h, k.h), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(o.h) * list_sum(k.h)))), 'item': k.item}}))[1] AS best
    FROM r JOIN h o ON o.sid = r.sid AND o.n = r.n + 1))
SELECT sid, item, leader, round(distance, 6) AS distance FROM r""",
    "logistic_scores": sql("timed", "SELECT event_id, floor(1 / (1 + exp(-((score_u - 5000) / 1000.0::DOUBLE))) * 100000 + 0.5) / 100000.0 AS probability FROM timed"),
}
SQL = {k: v.replace("\n, ", ",\n", 1) if v.startswith("WITH timed") or v.startswith("WITH turns") or v.startswith("WITH boxes") or v.startswith("WITH analyses") else v for k, v in SQL.items()}
QUERIES = {
    f.__name__: f
    for f in (
        cosine_pairs, centroid_weighted, representative_best, cooccurrence_pairs, iou_pairs, spatial_relations, person_regions, region_bucket, clamped_boxes,
        keyframe_select, candidate_frames, live_regions, bigram_jaccard, adjacent_scene_merge, view_bridging, graph_nodes, present_in, graph_objects, followed_by,
        topic_scene_overlap, discussed_in, unlinked_turns, graph_edges, graph_events, replay_snapshot, replay_reveals, replay_scene, graph_statistics, set_metrics_prf,
        identity_accuracy, macro_score, validation_violations, text_functions, joined_texts, relation_keys, unit_vectors, histogram_distance, logistic_scores,
        track_assignment, agglomerative_clusters, leader_clusters, strongest_cuts, bridged_fragments,
    )
}
