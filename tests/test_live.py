"""Golden cases of the live, model-request and annotation operators."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import evaluation, live, scoring


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_spaced_equals_a_plain_loop_over_many_batches(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(3000)) for k in (1, 2, 3, None) for _ in range(900)] + [(5, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = rows_of(live.spaced(spark.createDataFrame(rows, "k int, t long"), ["k"], "t", 25), "k", "t")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in (None, 1, 2, 3):
        last = None
        for t in sorted({t for key, t in rows if key == k and t is not None}):
            if last is None or t >= last + 25:
                want.append((k, t))
                last = t
    assert got == want
    assert live.spaced(spark.createDataFrame([], "k int, t long"), ["k"], "t", 25).count() == 0


def test_scene_needs_distance_and_length_and_is_sampled_within(spark):
    frames = [(1, 0, None), (1, 500, 0.9), (1, 1000, 0.45), (1, 1600, 0.44), (1, 1900, 0.9), (1, 2000, 0.5), (1, 31000, 0.1), (1, 32000, 0.1), (1, 62000, 0.9)]
    df = spark.createDataFrame(frames, "sid long, t long, d double")
    assert rows_of(live.scene_phases(df, ["sid"], "t", "d"), "t") == [
        (1, 0, 1, "scene_changed", 0, 1000), (1, 1000, 2, "scene_changed", 1000, 2000), (1, 2000, 3, "scene_changed", 2000, 62000),
        (1, 32000, 3, "scene_sampled", 2000, 62000), (1, 62000, 4, "scene_changed", 62000, None),
    ]


def test_adaptive_cut_stands_out_from_both_sides(spark):
    values = [1, 1, 1, 1, 40, 1, 1, 1, 1, 0, 0, 20, 0, 0, 1, 14, 1, 1, 1, 50]
    df = spark.createDataFrame([(1, i * 100, float(v)) for i, v in enumerate(values)], "sid long, t long, c double")
    assert [r[1] for r in rows_of(live.adaptive_cuts(df, ["sid"], "t", "c", min_len=400), "t")] == [400, 1100]
    assert [r[1] for r in rows_of(live.adaptive_cuts(df, ["sid"], "t", "c", min_len=800), "t")] == [1100]


def test_track_gets_the_most_similar_free_face_or_a_new_one(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, f, 0, 1, a) for f in (0, 1, 2)] + [(1, f, 1, 2, b) for f in (1, 2)] + [(1, f, 0, 3, [0.9, 0.1, 0.0]) for f in (20, 21)] + [(1, f, 1, 4, c) for f in (20, 21)]
    rows += [(2, 0, 0, 1, b), (2, 1, 0, 1, b), (2, 2, 0, 1, None)]
    df = spark.createDataFrame(rows, "sid long, frame long, det long, track long, embedding array<double>")
    got = rows_of(live.online_faces(df, min_observations=2, max_people=2), "sid", "frame", "det")
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [
        (1, 0, 1, None), (1, 1, 1, "Face-01"), (1, 1, 2, None), (1, 2, 1, "Face-01"), (1, 2, 2, "Face-02"), (1, 20, 3, None), (1, 20, 4, None),
        (1, 21, 3, "Face-01"), (1, 21, 4, None), (2, 0, 1, None), (2, 1, 1, "Face-01"),
    ]


def test_a_face_in_the_frame_is_not_given_again(spark):
    v = [1.0] * 4
    rows = [(1, f, d, d + 1, v) for f in (0, 1) for d in (0, 1)]
    df = spark.createDataFrame(rows, "sid long, frame long, det long, track long, embedding array<double>")
    assert [r[4] for r in rows_of(live.online_faces(df, min_observations=1), "frame", "det")] == ["Face-01", "Face-02"] * 2


STATES = [(1, 1, "A", "F1", "confirmed"), (1, 2, "A", "F1", "confirmed"), (1, 3, "A", "F1", "ambiguous"), (1, 3, "B", "F1", "confirmed"), (1, 4, "A", "F2", "confirmed"), (1, 4, "B", None, "unknown")]


def test_binding_changes_supersede_edges_and_labels(spark):
    df = spark.createDataFrame(STATES, "sid long, n long, speaker string, face_id string, status string")
    got = rows_of(live.binding_transitions(df, ["sid"], "n"), "n", "speaker")
    assert [r[1:] for r in got] == [
        (1, "A", "F1", "confirmed", True, None, 1), (3, "A", "F1", "ambiguous", False, "F1", 1), (3, "B", "F1", "confirmed", True, None, 1),
        (4, "A", "F2", "confirmed", True, None, 2), (4, "B", None, "unknown", False, "F1", 1),
    ]
    assert rows_of(live.speaker_labels(df, ["sid"], "n"), "face_id") == [(1, "F1", None), (1, "F2", "A")]
    assert rows_of(live.speaker_labels(df.where("n < 4"), ["sid"], "n"), "face_id") == [(1, "F1", "B")]


def test_metrics_take_the_last_frames_for_percentiles(spark):
    df = spark.createDataFrame([(1, i, 100 - i, -5) for i in range(100)], "sid long, n long, latency long, lag long")
    assert rows_of(live.frame_metrics(df, ["sid"], ["n"], "latency", "lag", recent=10), "sid") == [(1, 100, 50.5, 5.0, 10.0, 100, 0)]
    assert [r[1] for r in rows_of(live.event_window(df, ["sid"], "n", 3), "n")] == [97, 98, 99]


REQUESTS = "sid long, position long, keyframe_id string, metadata string"


def transport():
    def answer(asked):
        if any(x["keyframe_id"] == "down" for x in asked):
            raise OSError("network")
        if len(asked) > 1 and any(x.get("odd") for x in asked):
            return json.dumps({"keyframes": [{"keyframe_id": x["keyframe_id"]} for x in reversed(asked)]})
        if any(x["keyframe_id"] == "bad" for x in asked):
            return "no json"
        return json.dumps({"keyframes": [{"keyframe_id": x["keyframe_id"], "ok": 1} for x in asked]})

    return answer


def test_batches_fall_back_to_single_requests_and_stop_at_a_failure(spark):
    ids = {1: ["a", "b", "c", "d"], 2: ["a", "bad", "c", "d"], 3: ["a", "b", "down", "d"], 4: ["a"], 5: ["bad"]}
    odd = {(1, "a")}
    rows = [(s, i, k, json.dumps({"odd": True}) if (s, k) in odd else None) for s, ks in ids.items() for i, k in enumerate(ks)]
    got = scoring.analyse(spark.createDataFrame(rows, REQUESTS), transport(), "position", batch=2).cache()
    seen = {(r.sid, r.keyframe_id): (r.batch_id.removeprefix("semantic-batch-0000"), r.status) for r in got.collect()}
    assert [seen[1, k] for k in "abcd"] == [("1-part-01", "done"), ("1-part-02", "done"), ("2", "done"), ("2", "done")]
    assert [seen[2, k] for k in ids[2]] == [("1-part-01", "done"), ("1-part-02", "failed"), ("2", "pending"), ("2", "pending")]
    assert [seen[3, k] for k in ids[3]] == [("1", "done"), ("1", "done"), ("2", "failed"), ("2", "failed")]
    assert seen[4, "a"] == ("1", "done") and seen[5, "bad"] == ("1", "failed")
    assert rows_of(scoring.session_status(got).select("sid", "done", "status"), "sid") == [(1, 4, "complete"), (2, 1, "partial"), (3, 2, "partial"), (4, 1, "complete"), (5, 0, "partial")]
    assert scoring.analyse(spark.createDataFrame([], REQUESTS), transport(), "position").count() == 0


def test_only_cache_files_named_by_their_request_count(spark):
    stem = hashlib.sha256("v1m{}ab".encode()).hexdigest()
    file = lambda path, when, *answers: (1, path, when, "m", "{}", ["a", "b"], list(answers))
    rows = [file(f"/c/{stem}.json", 1, ("k1", "old"), ("k2", "x")), file(f"/d/{stem}.json", 2, ("k1", "new"), (None, "y")), file("/c/other.json", 3, ("k1", "wrong")), file(f"/c/{stem}.json.tmp", 4, ("k1", "part"))]
    df = spark.createDataFrame(rows, "sid long, path string, modified long, model string, metadata string, images array<string>, answers array<struct<keyframe_id:string,analysis:string>>")
    assert [r[1:3] for r in rows_of(scoring.cached_answers(df, "v1"), "keyframe_id")] == [("k1", "new"), ("k2", "x")]
    assert scoring.cached_answers(df, "v2").count() == 0


def test_retry_waits_as_told_and_gives_up():
    assert scoring.retry_delay("", "2.5", 0) == 2.5 and scoring.retry_delay("", "-1", 0) == 0
    assert scoring.retry_delay("Try again in 250ms", None, 0) == 0.25 and scoring.retry_delay("try again in 7.5s.", "soon", 0) == 7.5
    assert [scoring.retry_delay("", None, i) for i in range(6)] == [0.5, 1, 2, 4, 8, 8]
    waits, errors = [], [scoring.RateLimited("", "3"), TimeoutError(), ConnectionError()]

    def send(x):
        if errors:
            raise errors.pop(0)
        return x

    assert scoring.with_retries(send, sleep=waits.append)(5) == 5 and waits == [3.0, 1.0, 2.0]
    errors[:] = [scoring.RateLimited("", "61")]
    with pytest.raises(OSError):
        scoring.with_retries(send, sleep=waits.append)(5)
    errors[:] = [TimeoutError()] * 5
    with pytest.raises(OSError):
        scoring.with_retries(send, sleep=waits.append)(5)
    assert scoring.with_retries(send, sleep=waits.append)(6) == 6


@pytest.mark.parametrize("reply", ["", "[]", "{}", '{"keyframes": {}}', '{"keyframes": [{"keyframe_id": "b"}, {"keyframe_id": "a"}]}', '{"keyframes": [{"keyframe_id": "a"}, {"keyframe_id": "b"}, 3]}'])
def test_reply_must_hold_the_ids_asked_for_in_order(reply):
    with pytest.raises(ValueError):
        scoring.parse_reply(reply, ["a", "b"])


def test_features_begin_again_and_frames_are_strided(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], 1), ([[1.0]] * 9, 2), ([], 1), (None, 1), ([[1.0]], 0)], "f array<array<double>>, n int")
    got = [[x[0] for x in r[0]] for r in df.select(scoring.aligned_features(F.col("f"), F.col("n"), 1)).collect()]
    assert got == [[1, 2, 3, 1], [1] * 8, [0] * 4, [0] * 4, []]
    frames = spark.range(13).withColumnRenamed("id", "i")
    assert rows_of(scoring.sampled_frames(frames, "i", F.lit(29.97)), "i") == [(0, 0), (6, 200), (12, 400)]
    assert scoring.sampled_frames(frames, "i", F.lit(2.0)).count() == 13


def test_annotation_faults(spark):
    frames = spark.createDataFrame(
        [(1, "keyframe-00001", 0, "stage", None), (1, "keyframe-1", -1, "cellar", ["Cup", " "]), (1, "keyframe-00002", None, None, None), (1, "keyframe-00003", 1, None, None),
         (1, "keyframe-00004", 1, None, ["a_b", "A b"]), (1, "keyframe-00005", 1, None, ["chair", None]), (1, "keyframe-00006", 1, None, ["lamp"]), (1, "keyframe-00006", 1, "other", [])],
        "sid long, keyframe_id string, timestamp_ms long, environment_category string, object_labels array<string>",
    )
    relations = spark.createDataFrame(
        [(1, "keyframe-00003", "interactions", "b", "sitting_with", "a"), (1, "keyframe-00003", "interactions", "a", "sitting_with", "b"), (1, "keyframe-00001", "interactions", "", "above", None),
         (1, "keyframe-00001", "spatial_relations", "a", "above", "b"), (1, "keyframe-00001", "spatial_relations", "b", "above", "a")],
        "sid long, keyframe_id string, field string, subject string, predicate string, object string",
    )
    got = rows_of(evaluation.annotation_violations(frames, relations, ["sid"], ["Chair", "a b"]), "rule", "entity")
    assert [(r, e.removeprefix("1/keyframe-")) for r, e in got] == [
        ("blank_label", "00005"), ("blank_label", "1"), ("category", "1"), ("keyframe_id", "1"), ("keyframe_twice", "00006"), ("label_twice", "00004"), ("no_dimension", "00002"),
        ("no_subject", "00001"), ("outside_vocabulary", "00006"), ("predicate", "00001"), ("relation_twice", "00003"), ("timestamp", "00002"), ("timestamp", "1"),
    ]


def test_lineage_and_exclusion(spark):
    claimed = spark.createDataFrame([("scene", "tracks.json", "x"), ("scene", "speech.json", "y"), ("graph", "gone.json", "z")], "document string, path string, sha256 string")
    found = spark.createDataFrame([("tracks.json", "x"), ("speech.json", "other")], "path string, sha256 string")
    assert [r[1] for r in rows_of(evaluation.lineage_violations(claimed, found), "entity")] == ["graph/gone.json", "scene/speech.json"]
    active = spark.createDataFrame([(1, 0, "F1"), (1, 20, "F2"), (1, 40, "F1"), (1, 81, "F1"), (1, 99, "F1"), (1, 101, "F2")], "sid long, t long, face_id string")
    assert [r[1] for r in rows_of(evaluation.shared_bucket(active, ["sid"], "t", "face_id", "r"), "entity")] == ["1/0"]
