"""Timelines, provenance and atomic writes."""

import hashlib
import json

import pytest

from sessionloom.sources import documents


def test_timeline_forms_and_filters(spark, tmp_path):
    span = lambda **k: {"speaker": "A", "start_s": 0.0005, "end_s": 1.0} | k
    docs = [
        {"session_id": "s1", "speech_spans": [span(id="x"), span(speaker=None), span(speaker="unresolved"), span(status="draft"), span(attribution="overlap")]},
        {"session_id": "s2", "utterances": [{"speaker": "B", "start": 1, "end": 99.0}]},
        {"session_id": "s3", "segments": [span(start_s=5.0, end_s=5.0)]},
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    raw = documents.read_timeline(spark, str(tmp_path))
    got = sorted((r.sid, r.span_id, r.start_ms, r.end_ms) for r in documents.speech_spans(raw, 10_000).collect())
    assert got == [("s1", "x", 0, 1000), ("s2", "speech-interval-000001", 1000, 10000)]


def test_an_unknown_speaker_is_refused_or_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "s", "segments": [{"speaker": "speaker0", "start_s": 0, "end_s": 1}]}))
    raw = documents.read_timeline(spark, str(tmp_path))
    with pytest.raises(Exception, match="not a canonical speaker"):
        documents.speech_spans(raw, 1000).collect()
    assert documents.speech_spans(raw, 1000, strict=False).count() == 0


def test_versions_are_swapped_by_their_pointer(spark, tmp_path):
    path = f"{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        documents.read_current(spark, path)
    before = None
    for n in (1, 2, 3):
        documents.write_atomically(spark.range(n), path)
        assert documents.read_current(spark, path).count() == n
        if before is not None:
            assert before.count() == n - 1  # a reader that has begun
        before = documents.read_current(spark, path)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v")]) == 2
    # A writer that dies before the swap leaves what was there.
    spark.range(9).write.json(f"{path}/v000000009-dead")
    assert documents.read_current(spark, path).count() == 3


def test_provenance(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert documents.provenance(spark, f"{tmp_path}/f.bin").first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_logs_and_snapshots_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "sid long, type string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sid long, type string").parquet(f"{tmp_path}/in")
    documents.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.schema("type string, sid long").json(f"{tmp_path}/log").collect()) == [("a", 1), ("b", 1), ("c", 2)]
    documents.snapshot_log(stream.groupBy("sid").count(), f"{tmp_path}/snap", f"{tmp_path}/c2").awaitTermination(60)
    assert sorted((r.sid, r["count"]) for r in documents.read_current(spark, f"{tmp_path}/snap").collect()) == [(1, 2), (2, 1)]
