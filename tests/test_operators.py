"""Golden cases of the relational operators."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import activity, binding, dialogue, evaluation, graph, intervals, people, semantics, spatial, vectors
from sessionloom.operators.replay import ReplayClock
from sessionloom.streaming.speaking import SILENT, SpeakingPhases


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def as_tuples(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


SPAN = "sid long, span_id string, speaker string, start_ms long, end_ms long"
SEG = "sid long, face_id string, start_ms long, end_ms long"


def test_touching_intervals_merge_and_ids_keep_their_order(spark):
    rows = [(1, 0, 10, ["a"]), (1, 10, 20, ["b"]), (1, 25, 30, ["a"]), (1, 29, 31, ["c"])]
    df = frame(spark, rows, "k long, start_ms long, end_ms long, ids array<string>")
    got = as_tuples(intervals.merge_intervals(df, ["k"], ids="ids"), "start_ms")
    assert got == [(1, 0, 20, 2, ["a", "b"]), (1, 25, 31, 2, ["a", "c"])]
    assert [r[1] for r in as_tuples(intervals.union_duration(df, ["k"]), "k")] == [26]
    assert as_tuples(intervals.merge_intervals(df, ["k"], gap_ms=5).select("start_ms", "end_ms"), "start_ms") == [(0, 31)]


def test_bucketed_overlap_equals_the_plain_join(spark):
    left = frame(spark, [(1, i, i * 7, i * 7 + 1 + i % 30) for i in range(60)], "sid long, a long, start_ms long, end_ms long")
    right = frame(spark, [(1, i, i * 5, i * 5 + 1 + i % 17) for i in range(80)], "sid long, b long, start_ms long, end_ms long")
    got = {(r.a, r.r_b, r.overlap_ms) for r in intervals.overlap_join(left, right, ["sid"], 16).collect()}
    want = set()
    for a in range(60):
        for b in range(80):
            o = min(a * 7 + 1 + a % 30, b * 5 + 1 + b % 17) - max(a * 7, b * 5)
            if o > 0:
                want.add((a, b, o))
    assert got == want


def test_optimal_assignment_beats_the_greedy_one(spark):
    rows = [(1, "A", "Face-01", 900), (1, "A", "Face-02", 800), (1, "B", "Face-01", 850), (1, "B", "Face-02", 100)]
    got = dict(r[1:] for r in as_tuples(binding.assign(frame(spark, rows, "sid long, speaker string, face_id string, overlap_ms long")), "speaker"))
    assert got == {"A": "Face-02", "B": "Face-01", "C": None, "D": None}


def test_binding_statuses(spark):
    segs = frame(spark, [(1, "Face-01", 0, 900), (1, "Face-01", 2000, 2400), (1, "Face-02", 1000, 2000)], SEG)
    speech = frame(spark, [(1, "a", "A", 0, 1000), (1, "b", "B", 1000, 2000), (1, "c", "C", 3000, 4000)], SPAN)
    got = {r.speaker: r for r in binding.bind(speech, segs, 500, 0.5, 0.2).collect()}
    assert (got["A"].status, got["A"].overlap_ms, got["B"].status) == ("confirmed", 900, "confirmed")
    assert (got["C"].face_id, got["C"].status) == (None, "offscreen")
    short = binding.bind(frame(spark, [(1, "a", "A", 0, 2500)], SPAN), frame(spark, [(1, "Face-01", 0, 2500)], SEG)).first()
    assert short.status == "candidate"


def test_relabel_corrects_the_wrong_span(spark):
    segs = frame(spark, [(1, "Face-01", 0, 10000), (1, "Face-02", 10000, 20000)], SEG)
    spans = frame(spark, [(1, "s1", "A", 0, 8000), (1, "wrong", "B", 8000, 10000), (1, "s3", "B", 10000, 20000)], SPAN)
    bound = frame(spark, [(1, "A", "Face-01", "confirmed", 0.9), (1, "B", "Face-02", "confirmed", 0.9)], "sid long, speaker string, face_id string, status string, confidence double")
    assert [(r.span_id, r.speaker) for r in binding.relabel(spans, segs, bound).collect()] == [("wrong", "A")]


def test_reconcile_becomes_stable(spark):
    segs = frame(spark, [(1, "Face-01", 0, 10000), (1, "Face-02", 10000, 20000)], SEG)
    spans = frame(spark, [(1, "s1", "A", 0, 8000), (1, "wrong", "B", 8000, 10000), (1, "s3", "B", 10000, 20000)], SPAN)
    fixed, passes, stable = binding.reconcile(spans, segs)
    assert (passes, stable) == (2, True)
    assert {r.span_id: r.speaker for r in fixed.collect()} == {"s1": "A", "wrong": "A", "s3": "B"}


def test_elementary_visibility_and_cuts(spark):
    speech = frame(spark, [(1, "A", 0, 3000), (1, "A", 6000, 7000)], "sid long, speaker string, start_ms long, end_ms long")
    cover = frame(spark, [(1, "A", 0, 1000), (1, "A", 1500, 3000)], "sid long, speaker string, start_ms long, end_ms long")
    none = frame(spark, [], "sid long, cut_ms long")
    states = lambda cuts: [(r.start_ms, r.end_ms, r.state) for r in intervals.elementary_states(speech, cover, cuts, ["sid", "speaker"], 1200, 100).orderBy("start_ms").collect()]
    assert states(none) == [(0, 1000, "visible"), (1000, 1500, "occluded"), (1500, 3000, "visible"), (6000, 7000, "offscreen")]
    assert states(frame(spark, [(1, 1200)], "sid long, cut_ms long"))[1] == (1000, 1500, "offscreen")
    assert states(frame(spark, [(1, 1500)], "sid long, cut_ms long"))[1] == (1000, 1500, "offscreen")
    # Coverage that ends before the speech begins bridges nothing.
    late = frame(spark, [(1, "A", 1500, 3000)], "sid long, speaker string, start_ms long, end_ms long")
    early = frame(spark, [(1, "A", 0, 1000), (1, "A", 2000, 3000)], "sid long, speaker string, start_ms long, end_ms long")
    got = intervals.elementary_states(late, early, none, ["sid", "speaker"], 1200, 100).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.state, r.reason, r.confidence) for r in got] == [(1500, 2000, "offscreen", "bound_face_absent", 0.85), (2000, 3000, "visible", "face_track_present", None)]


def test_visibility_by_binding_status(spark):
    speech = frame(spark, [(1, s, 0, 1000) for s in "ABCD"], "sid long, speaker string, start_ms long, end_ms long")
    bound = frame(spark, [(1, "A", "Face-01", "confirmed", 0.7), (1, "B", "Face-02", "ambiguous", 0.4), (1, "C", None, "offscreen", 0.0)], "sid long, speaker string, face_id string, status string, confidence double")
    cover = frame(spark, [(1, "Face-01", 0, 300), (1, "Face-01", 600, 800), (1, "Face-02", 0, 1000)], "sid long, face_id string, start_ms long, end_ms long")
    got = intervals.classify_visibility(speech, bound, cover, frame(spark, [], "sid long, cut_ms long"), 300, 100)
    assert sorted((r.speaker, r.start_ms, r.end_ms, r.state, r.confidence) for r in got.collect()) == [
        ("A", 0, 300, "visible", 0.7), ("A", 300, 600, "occluded", 0.65), ("A", 600, 800, "visible", 0.7), ("A", 800, 1000, "offscreen", 0.7),
        ("B", 0, 1000, "unknown", 0.9), ("C", 0, 1000, "offscreen", 0.75), ("D", 0, 1000, "unknown", 0.9),
    ]


def test_interleaved_rows_keep_states_apart(spark):
    rows = [(1, "A", "visible", 0, 10), (1, "B", "visible", 5, 12), (1, "A", "visible", 10, 20), (1, "A", "visible", 20, 30)]
    got = intervals.merge_states(frame(spark, rows, "sid long, speaker string, state string, start_ms long, end_ms long"), ["sid"], ["speaker", "state"])
    assert [(r.speaker, r.start_ms, r.end_ms) for r in got.orderBy("start_ms").collect()] == [("A", 0, 10), ("B", 5, 12), ("A", 10, 30)]


def test_split_long(spark):
    got = intervals.split_long(frame(spark, [(0, 15000), (15000, 82000)], "start_ms long, end_ms long"), 30000)
    assert as_tuples(got, "start_ms") == [(0, 15000), (15000, 45000), (45000, 75000), (75000, 82000)]


def test_exclusive_winner_and_run_lengths(spark):
    rows = [(1, f, t * 40, s) for f, s in (("a", 20), ("b", 2)) for t in range(10)]
    got = activity.exclusive(frame(spark, rows, "sid long, face_id string, t long, score long"), ["sid"], "t", [F.desc("score"), F.col("face_id")])
    assert {r.face_id for r in got.where("winner").collect()} == {"a"}
    flags = [1, 1, 1, 0, 1, 1, 0, 0, 0, 1, 0]
    df = frame(spark, [(1, i, bool(x)) for i, x in enumerate(flags)], "sid long, i long, x boolean")
    done = activity.postprocess(df, ["sid"], ["i"], F.col("x"), bridge=1, least=3)
    assert [int(r.active) for r in done.orderBy("i").collect()] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_speaking_machine_batch_and_incremental_agree(spark):
    series = {"01": range(0, 1000, 40), "02": range(1000, 2000, 40)}
    rows = [(1, f, t, t in on) for f, on in series.items() for t in range(0, 2000, 40)]
    df = frame(spark, rows, "sid long, face_id string, t long, speaking boolean")
    got = {r.face_id: (r.started_ms, r.ended_ms) for r in activity.speaking_phases(df, ["sid", "face_id"], 2000, 200, 600).collect()}
    assert got == {"01": (0, 1000), "02": (1000, None)}
    machine = SpeakingPhases(200, 600)
    state, first = machine.advance(SILENT, [(t, True) for t in range(0, 1000, 40)], 0, 1000)
    assert first == [(0, "started")]
    state, second = machine.advance(state, [(t, False) for t in range(1000, 2000, 40)], 1000, 2000)
    assert second == [(1000, "ended")] and state == SILENT


def test_speaking_machine_over_chunks():
    machine = SpeakingPhases(200, 1000)
    state, first = machine.advance(SILENT, [(t, True) for t in range(0, 1000, 40)], 0, 1000)
    assert first == [(0, "started")]
    state, quiet = machine.advance(state, [], 1000, 1960)
    assert quiet == []  # 960 ms of silence by the end of the chunk
    state, again = machine.advance(state, [(t, t >= 2200) for t in range(1960, 2960, 40)], 1960, 2960)
    # By the end of this chunk the silence from 1000 on is long enough, before its first voice.
    assert again == [(1000, "ended"), (2200, "started")]
    assert machine.advance((True, None, None), [(1960, True), (2000, False), (2040, True)], 1960, 2080)[1] == [(1960, "continued")]
    # Samples before and after a chunk without any are not one run; at equal times voice wins.
    state, _ = machine.advance(SILENT, [(0, True), (40, True), (80, True), (120, True)], 0, 160)
    state, _ = machine.advance(state, [], 160, 320)
    assert machine.advance(state, [(320, True), (320, False)], 320, 360)[1] == []


def test_replay_clock():
    now = [0.0]
    clock = ReplayClock(10_000, 2.0, clock=lambda: now[0])
    now[0] = 1.25
    assert (clock.position_ms, clock.status) == (2500, "playing")
    clock.control("pause")
    now[0] = 9.0
    assert (clock.position_ms, clock.status) == (2500, "paused")
    clock.control("seek", 9000)
    clock.control("resume")
    now[0] = 11.0
    assert (clock.position_ms, clock.status) == (10_000, "complete")
    clock.control("restart")
    assert (clock.position_ms, clock.status) == (0, "playing")
    for action, at in (("seek", 10_001), ("seek", None), ("jump", 1)):
        with pytest.raises(ValueError):
            clock.control(action, at)
    with pytest.raises(ValueError):
        ReplayClock(10, 0.01)


def test_disputed_faces_are_identity_candidates(spark):
    bound = frame(spark, [(1, "A", "Face-01", "confirmed", 0.8), (1, "B", "Face-02", "ambiguous", 0.4)], "sid long, speaker string, face_id string, status string, confidence double")
    rows = [(1, "A", "Face-01", 900, 0.9), (1, "A", "Face-02", 500, 0.5), (1, "B", "Face-02", 700, 0.7), (1, "B", "Face-01", 2000, 0.6)]
    links = people.associations(frame(spark, rows, "sid long, speaker string, face_id string, overlap_ms long, coverage double"), bound)
    got = {(r.speaker, r.face_id): (r.state, r.confidence) for r in links.collect()}
    assert got == {("A", "Face-01"): ("confirmed", 0.8), ("B", "Face-02"): ("disputed", 0.4), ("B", "Face-01"): ("disputed", 0.6)}
    who = frame(spark, [(1, "A", "Ann"), (1, "B", None), (1, "C", None)], "sid long, speaker string, display_name string")
    nodes = people.person_nodes(frame(spark, [(1, "Face-01"), (1, "Face-02")], "sid long, face_id string"), bound, who)
    assert {r.id: (r.label, r.identity_status) for r in nodes.collect()} == {
        "person:speaker:A": ("Ann", "confirmed"), "visual_identity:Face-02": ("Face-02", "unconfirmed"), "person:speaker:B": ("B", "unbound"), "person:speaker:C": ("C", "unbound"),
    }
    evidence = frame(spark, [(1, "B", "Face-02", 5, 9), (1, "B", "Face-02", 20, 30)], "sid long, speaker string, face_id string, start_ms long, end_ms long")
    edges = {(r.source, r.target): (r.start_ms, r.end_ms) for r in people.identity_candidates(links, evidence, nodes).collect()}
    assert edges == {("person:speaker:B", "visual_identity:Face-02"): (5, 30), ("person:speaker:B", "person:speaker:A"): (0, 0)}


def test_evidence_ids_do_not_collide(spark):
    same = frame(spark, [(1, "x", "{}"), (1, "x", "{}")], "sid long, id string, content string")
    assert people.one_payload(same).count() == 1
    with pytest.raises(Exception, match="collision"):
        people.one_payload(same.union(frame(spark, [(1, "x", "{1}")], "sid long, id string, content string"))).collect()


def test_topics_opinions_and_intents(spark):
    turns = frame(
        spark, [(1, 1, "A", ["work", " work"], "ask", 0, 5), (1, 2, "B", [], "answer", 5, 9), (1, 3, "A", [], "ask", 9, 12)],
        "sid long, turn_id long, speaker string, topics array<string>, intent string, start_ms long, end_ms long",
    )
    scene = frame(spark, [(1, 1, "home", [3]), (1, 2, "nothing", [])], "sid long, n long, name string, turn_ids array<long>")
    got = {r.name: (r.id, r.turn_ids) for r in dialogue.topic_catalog(turns, scene).collect()}
    assert got == {"home": ("topic:0001", [3]), "nothing": ("topic:0002", []), "work": ("topic:0003", [1]), dialogue.NO_TOPIC: ("topic:0004", [2])}
    assert {r.name: (r.id, r.start_ms, r.end_ms, r.speakers) for r in dialogue.intents(turns).collect()} == {"ask": ("intent:0001", 0, 12, ["A"]), "answer": ("intent:0002", 5, 9, ["B"])}
    assert dialogue.dialogue_edges(turns, scene).groupBy("predicate").count().orderBy("predicate").collect() == [("about", 3), ("expresses", 3), ("has_intent", 3)]


def test_running_median_with_zeros_at_the_ends(spark):
    rows = [(1, i, float(v)) for i, v in enumerate((5, 9, 1, 7, 3))] + [(2, 0, 4.0), (2, 1, 8.0)]
    got = activity.median_smooth(frame(spark, rows, "k long, i long, v double"), ["k"], ["i"], "v", kernel=3)
    assert [r.smooth for r in got.orderBy("k", "i").collect()] == [5.0, 5.0, 7.0, 3.0, 3.0, 4.0, 8.0]


def test_evidence_is_held_against_the_timeline(spark):
    spans = frame(spark, [(1, 1, "A", 0, 1000, "good mor"), (1, 2, "A", 1000, 2000, "ning all"), (1, 3, "B", 0, 2000, "other")], "sid long, span_id long, speaker string, start_ms long, end_ms long, text string")
    claims = [(1, 1, "A", 0, 2200, "Good morning".lower()), (1, 2, "A", 0, 2300, "good morning"), (1, 3, "B", 0, 2000, "good"), (1, 4, "C", 0, 10, "x")]
    got = people.verified_evidence(frame(spark, claims, "sid long, evidence_id long, speaker string, start_ms long, end_ms long, text string"), spans, 500)
    assert {r.evidence_id: r.verified for r in got.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_hashes_of_evidence_and_requests(spark):
    schema = "sid long, speaker string, face_id string, overlap_ms long"
    rows = [(1, "B", "Face-01", 5), (1, "A", "Face-02", 7)]
    one = binding.evidence_hash(frame(spark, rows, schema)).first().evidence_sha256
    assert one == binding.evidence_hash(frame(spark, rows[::-1], schema)).first().evidence_sha256
    assert one != binding.evidence_hash(frame(spark, [*rows[:1], (1, "A", "Face-02", 8)], schema)).first().evidence_sha256
    asked = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "request_sha256 string, n long")
    assert [r.request_sha256 for r in semantics.pending(asked, frame(spark, [("b",)], "request_sha256 string")).collect()] == ["a"]


def test_segments_join_the_last_one_only(spark):
    rows = [(1, 1, "a", 0, 10, 5), (1, 2, "b", 11, 20, 1), (1, 3, "a", 15, 30, 2), (1, 4, "a", 32, 40, 9), (1, 5, "a", 60, 70, 3)]
    got = activity.chained_segments(frame(spark, rows, "sid long, n long, face_id string, start_ms long, end_ms long, score long"), ["sid"], ["face_id"], 5)
    assert sorted((r.start_ms, r.end_ms, r.face_id, r.score) for r in got.collect()) == [(0, 10, "a", 5), (11, 20, "b", 1), (15, 40, "a", 9), (60, 70, "a", 3)]


def test_semantics_are_normalised(spark):
    df = spark.sql("""SELECT 'indoor_office' AS category, 'A Stage with lights' AS description, 0.5D AS confidence, array(named_struct('label', 'logo', 'confidence', 0.5D), named_struct('label', ' Mic ', 'confidence', 0.5D)) AS objects,
      array(named_struct('subject', 'Face-01', 'predicate', 'speaking', 'object', 'Face-02'), named_struct('subject', 'Face-01', 'predicate', 'looking_at', 'object', 'Face-09'), named_struct('subject', 'Face-01', 'predicate', 'holding', 'object', 'object:cup')) AS interactions,
      array('Face-01') AS faces""")
    row = semantics.scene_objects(semantics.repair_environment(df)).first()
    assert row.category == "stage" and [o.label for o in row.objects] == ["microphone"]
    faint = semantics.scene_objects(semantics.repair_environment(df.withColumn("confidence", F.lit(0.2)))).first()
    assert (faint.category, faint.confidence, [o.label for o in faint.objects]) == ("graphic_or_title", 0.6, ["logo", "microphone"])
    assert [x.predicate for x in semantics.group_speech_only(df).first().interactions] == ["looking_at", "holding"]
    assert [x.predicate for x in semantics.visible_interactions(df, "faces").first().interactions] == ["holding"]


def test_tracks_weigh_detections_by_quality(spark):
    import math

    side = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, 0, 0, [0.0, 0.0, 9.0, 9.0], side(0.0), 1.0), (1, 1, 0, [0.0, 0.0, 9.0, 9.0], side(1.2), 0.0), (1, 2, 0, [50.0, 0.0, 9.0, 9.0], side(0.3), 1.0)]
    df = frame(spark, rows, "sid long, frame long, det long, box array<double>, embedding array<double>, quality double")
    # By quality the track stays at angle 0 and takes the third detection by likeness alone; unweighted it has turned away.
    assert [r.track for r in vectors.track(df, 2, reid=0.94).orderBy("frame").collect()] == [1, 1, 1]
    assert [r.track for r in vectors.track(df.drop("quality"), 2, reid=0.96).orderBy("frame").collect()] == [1, 1, 2]


def test_segments_split_at_gaps(spark):
    df = frame(spark, [(1, "a", t, 1) for t in (0, 40, 80, 200, 280)], "sid long, face_id string, t long, score_u long")
    got = activity.segments(df, ["sid", "face_id"], "t")
    assert [(r.start_ms, r.end_ms, r.n) for r in got.orderBy("start_ms").collect()] == [(0, 120, 3), (200, 320, 2)]


def test_tracking_keeps_identities_when_faces_cross(spark):
    rows = []
    for f in range(10):
        rows += [(1, f, 0, [f * 10.0, 0.0, 20.0, 20.0], [1.0, 0.0]), (1, f, 1, [90.0 - f * 10, 0.0, 20.0, 20.0], [0.0, 1.0])]
    df = frame(spark, rows, "sid long, frame long, det long, box array<double>, embedding array<double>")
    for greedy in (False, True):
        got = {(r.det, r.track) for r in vectors.track(df, 2, greedy=greedy).collect()}
        assert got == {(0, 1), (1, 2)}


def test_hungarian_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for n, m in ((3, 3), (2, 4), (4, 2), (5, 5)):
        cost = rng.random((n, m))
        got = sum(cost[i, j] for i, j in vectors.hungarian(cost))
        short, long = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        want = min(sum(c[i, p[i]] for i in range(short)) for p in itertools.permutations(range(long), short))
        assert abs(got - want) < 1e-9


def test_clusters_respect_conflicts(spark):
    rows = [(1, 1, 0, 1.0, [1.0, 0.0]), (1, 2, 5, 1.0, [0.9, 0.1]), (1, 3, 9, 1.0, [0.0, 1.0]), (1, 4, 12, 1.0, [0.1, 0.9])]
    tracks = frame(spark, rows, "sid long, track long, start_ms long, weight double, embedding array<double>")
    free = vectors.agglomerate(tracks, frame(spark, [], "sid long, a long, b long"), 0.75)
    assert {r.track: r.face for r in free.collect()} == {1: 1, 2: 1, 3: 2, 4: 2}
    apart = vectors.agglomerate(tracks, frame(spark, [(1, 1, 2)], "sid long, a long, b long"), 0.75)
    assert len({r.face for r in apart.collect()}) == 3


def test_cut_suppression(spark):
    df = frame(spark, [(1, 0, 5), (1, 200, 9), (1, 450, 7), (1, 900, 1)], "sid long, t long, s long")
    assert as_tuples(vectors.strongest_cuts(df, ["sid"], "t", "s"), "t") == [(1, 200, 9), (1, 900, 1)]


def test_spatial_relations(spark):
    rows = [(1, 1, 0.1, 0.35, 0.2, 0.1, 0.9), (1, 2, 0.6, 0.4, 0.2, 0.1, 0.8)]
    df = frame(spark, rows, "keyframe_id long, state long, x double, y double, w double, h double, confidence double")
    got = {(r.predicate, r.subject, r.object, round(r.confidence, 6)) for r in spatial.relations(spatial.person_states(df)).collect()}
    assert got == {("co_visible_with", 1, 2, 0.8), ("left_of", 1, 2, 0.8)}


def test_candidate_frames_and_their_neighbours(spark):
    shots = frame(spark, [(1, 0, 24), (2, 100, 105), (3, 7, 7)], "shot long, first long, last long")
    seen = frame(spark, [(1, 0), (1, 10), (1, 14), (1, 24), (2, 100)], "shot long, frame long")
    got = spatial.candidate_frames(shots, seen, ["shot"]).groupBy("shot").agg(F.sort_array(F.collect_list("frame")).alias("f")).collect()
    # Targets 5, 12, 19 and 101, 102 (half to even), 104; of equally near frames the earlier.
    assert {r["shot"]: r["f"] for r in got} == {1: [0, 5, 10, 12, 14, 19], 2: [100, 101, 102, 104], 3: [7]}


def test_keyframe_prefers_more_faces(spark):
    df = frame(spark, [(1, 10, 1.0, 2.0, 0.1), (1, 20, 9.0, 1.0, 0.1)], "shot long, frame long, sharpness double, faces double, area double")
    assert spatial.select_keyframes(df, ["shot"]).first().frame == 10


def test_view_bridging(spark):
    schema = "sid string, keyframe_id long, group long, category string, view long, start_ms long, end_ms long"
    rows = [("s", 1, 1, "home", 7, 0, 10), ("s", 2, 2, "home", 8, 10, 20), ("s", 3, 3, "home", 7, 20, 30)]
    assert {r.group for r in graph.bridge_views(frame(spark, rows, schema)).collect()} == {1}
    # Two short units of the middle group with a long way between them.
    apart = [rows[0], ("s", 2, 2, "home", 8, 10, 1010), ("s", 4, 2, "home", 9, 50_010, 51_010), ("s", 3, 3, "home", 7, 60_000, 60_010)]
    assert {r.group for r in graph.bridge_views(frame(spark, apart, schema)).collect()} == {1}
    rows[1] = ("s", 2, 2, "stage", 8, 10, 20)
    assert {r.group for r in graph.bridge_views(frame(spark, rows, schema)).collect()} == {1, 2, 3}


def test_turn_over_two_scenes(spark):
    turns = frame(spark, [(1, 2, 800, 1400)], "sid long, turn_id long, start_ms long, end_ms long")
    scenes = frame(spark, [(1, 1, 0, 1000), (1, 2, 1000, 2000)], "sid long, scene_id long, start_ms long, end_ms long")
    got = [(r.overlap_start, r.overlap_end, r.turn_coverage) for r in graph.occurred_in(turns, scenes).orderBy("overlap_start").collect()]
    assert got == [(800, 1000, 0.333333), (1000, 1400, 0.666667)]


def test_event_projection_and_replay(spark):
    nodes = frame(spark, [(1, 1, "scene:1", "scene", 0), (1, 2, "scene:2", "scene", 1000), (1, 3, "person:A", "person", 0)], "sid long, n long, id string, type string, start_ms long")
    edges = frame(spark, [(1, 1, "e1", "person:A", "scene:1", "speaking", 200), (1, 2, "e2", "person:A", "scene:2", "present_in", 1200)], "sid long, n long, id string, source string, target string, predicate string, start_ms long")
    events = graph.graph_events(nodes, edges)
    assert [(r.t, r.type) for r in events.orderBy("sequence").collect()] == [(0, "scene_changed"), (200, "person_speaking"), (1000, "scene_changed"), (1200, "person_seen")]
    assert {(r.what, r.id) for r in graph.revealed(events, 200).collect()} == {("node", "scene:1"), ("node", "person:A"), ("edge", "e1")}
    assert [r.sequence for r in graph.snapshot(events, 1200, 2).orderBy("sequence").collect()] == [3, 4]
    scenes = frame(spark, [(1, 1, 0, 1000), (1, 2, 1000, 2000)], "sid long, scene_id long, start_ms long, end_ms long")
    assert [graph.current_scene(scenes, t).first().scene_id for t in (999, 1000, 2000)] == [1, 2, 2]


def test_set_metrics_and_macro(spark):
    df = frame(spark, [("m", ["a", "b"], ["a", "c"]), ("m", None, ["z"]), ("m", [], [])], "k string, e array<string>, p array<string>")
    got = evaluation.set_metrics(df, "e", "p", ["k"]).first()
    assert (got.frames, got.tp, got.fp, got.fn, got.f1) == (2, 1, 1, 1, 0.5)
    one = spark.range(1).select(evaluation.macro([F.lit(0.5), F.lit(None).cast("double"), F.lit(0.7)]).alias("m")).first()
    assert one.m == 0.6


def test_labels_and_relations(spark):
    row = spark.range(1).select(
        X.canonical_label(F.lit(" Potted-Plant ")).alias("a"), X.canonical_label(F.lit("mic")).alias("b"), X.bigrams(F.lit("A b!")).alias("c"), X.bigrams(F.lit("é")).alias("d"),
        X.join_texts(F.array(F.lit("one"), F.lit("two"), F.lit("。x"))).alias("e"), X.relation_key(F.lit("z"), F.lit("co_visible_with"), F.lit("a")).alias("f"),
        X.object_key(F.lit("\tCoffee  Cup\n")).alias("g"), X.canonical_label(F.lit("-Potted-Plant-")).alias("h"), X.join_texts(F.array(F.lit("abc\n"), F.lit("def"))).alias("i"),
    ).first()
    assert (row.g, row.h, row.i) == ("coffee_cup", "plant", "abc\ndef")
    assert (row.a, row.b, row.c, row.d, row.e, tuple(row.f)) == ("plant", "microphone", ["ab"], ["é"], "one two。x", ("a", "co_visible_with", "z"))
