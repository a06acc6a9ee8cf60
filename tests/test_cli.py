"""Commands over small documents."""

import json

import pytest

from sessionloom.cli import main
from sessionloom.sources import documents


def part(start, end, n, kind, face):
    return {f"{kind}_id": f"{kind}-{n}", "face_id": face, "start_ms": start, "end_ms": end, "score": 0.9}


@pytest.fixture()
def folder(tmp_path):
    visual = {
        "session_id": "s1", "source": {"duration_ms": 20_000, "path": "a.mp4"}, "processing": {"sample_fps": 5},
        "tracklets": [part(0, 9000, 1, "tracklet", "Face-01"), part(9800, 12_000, 2, "tracklet", "Face-01"), part(0, 19_900, 3, "tracklet", "Face-02"), part(0, 5, 4, "tracklet", None)],
        "active_speaker_segments": [part(0, 6000, 1, "segment", "Face-01"), part(10_000, 16_000, 2, "segment", "Face-02"), part(0, 9, 3, "segment", None)],
        "speaker_face_associations": [
            {"speaker_label": "A", "face_id": "Face-01", "status": "confirmed", "confidence": 0.95}, {"speaker_label": "B", "face_id": "Face-02", "status": "confirmed", "confidence": 0.6},
        ],
    }
    spans = [("A", 0.0, 11.0), ("B", 11.0, 16.0), ("B", 1.0, 5.0), ("C", 17.0, 18.0), ("unresolved", 0.0, 1.0)]
    (tmp_path / "visual").mkdir()
    (tmp_path / "speech").mkdir()
    (tmp_path / "graph").mkdir()
    (tmp_path / "visual" / "s1.json").write_text(json.dumps(visual))
    (tmp_path / "speech" / "s1.json").write_text(json.dumps({"session_id": "s1", "speech_spans": [{"speaker": s, "start_s": a, "end_s": b} for s, a, b in spans]}))
    nodes = [{"id": "scene:1", "type": "scene", "label": "x", "attributes": {"start_ms": 0, "end_ms": 900}}, {"id": "p", "type": "person", "label": "A", "attributes": {"k": 1}}]
    edges = [{"id": "edge-1", "source": "p", "target": "scene:1", "predicate": "present_in", "start_ms": 5, "end_ms": 9}, {"id": "edge-1", "source": "p", "target": "q", "predicate": "holding", "start_ms": 7, "end_ms": 6}]
    (tmp_path / "graph" / "s1.json").write_text(json.dumps({"session_id": "s1", "nodes": nodes, "edges": edges}))
    return tmp_path


def run(spark, folder, *args):
    paths = [f"{folder}/{a}" if a in ("visual", "speech", "graph") else a for a in args]
    return [r.asDict() for r in main([*paths, "--output", f"{folder}/out"], spark).collect()]


def test_bind_and_reconcile(spark, folder):
    bound = {r["speaker"]: (r["face_id"], r["overlap_ms"], r["status"]) for r in run(spark, folder, "bind-speakers", "visual", "speech", "--min-margin", "0.05")}
    assert bound == {"A": ("Face-01", 6000, "confirmed"), "B": ("Face-02", 5000, "confirmed"), "C": (None, 0, "offscreen")}
    assert documents.read_current(spark, f"{folder}/out").count() == 3
    spans = {r["start_ms"]: (r["speaker"], r["original_speaker"]) for r in run(spark, folder, "reconcile-speakers", "visual", "speech")}
    assert spans == {0: ("A", None), 1000: ("A", "B"), 11_000: ("B", None), 17_000: ("C", None)}


def test_visibility_knows_cuts(spark, folder):
    rows = run(spark, folder, "classify-visibility", "visual", "speech")
    assert [(r["start_ms"], r["end_ms"], r["state"]) for r in sorted(rows, key=lambda r: r["start_ms"]) if r["speaker"] == "A"] == [
        (0, 9200, "visible"), (9200, 9800, "occluded"), (9800, 11_000, "visible"),
    ]
    assert {r["state"] for r in rows if r["speaker"] == "C"} == {"unknown"}
    (folder / "cuts.json").write_text(json.dumps({"session_id": "s1", "shot_boundaries_ms": [9500]}))
    rows = run(spark, folder, "classify-visibility", "visual", "speech", "--cuts", f"{folder}/cuts.json")
    assert {r["state"] for r in rows if r["start_ms"] == 9200} == {"offscreen"}


def test_replay_and_rules(spark, folder):
    assert [r["type"] for r in sorted(run(spark, folder, "replay-vision", "graph", "--start-ms", "5"), key=lambda r: r["sequence"])] == ["scene_changed", "person_seen"]
    found = sorted((r["rule"], r["entity"]) for r in run(spark, folder, "validate-graph", "graph"))
    assert found == [("edge_time", "edge-1"), ("edge_unique", "s1/edge-1"), ("target_exists", "edge-1")]
    assert run(spark, folder, "validate", "visual") == []
    with pytest.raises(SystemExit):
        main(["query", "no_such", "x"], spark)


def test_lenient_timeline_warns(spark, folder):
    assert documents.read_timeline_leniently(spark, f"{folder}/none")[1] == [f"no speech timeline at {folder}/none"]
    (folder / "speech" / "bad.json").write_text("{not json")
    (folder / "speech" / "bare.json").write_text('{"session_id": "s9"}')
    spans, told = documents.read_timeline_leniently(spark, f"{folder}/speech")
    assert spans.count() == 5 and told == ["1 speech timelines can't be read", "1 speech timelines have no spans"]
    assert documents.speech_spans(spans, 20_000, strict=False).count() == 4
