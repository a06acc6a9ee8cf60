"""Commands over session documents: ``python -m sessionloom COMMAND ...``.

Paths may be folders or globs with a document for each session; documents of
one session share ``session_id``. Results are versioned JSON documents under
``--output`` (see ``write_atomically``), or rows on the screen.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import binding, evaluation, graph, intervals
from .sources.documents import read_timeline, speech_spans, write_atomically
from .sources.visual import VisualDocuments, read_cuts, read_graph


def _speech(spark: SparkSession, visual: VisualDocuments, path: str, offset_ms: int) -> DataFrame:
    raw = read_timeline(spark, path).join(visual.sessions, "sid")
    return speech_spans(raw, F.col("duration_ms"), offset_ms).select("sid", "span_id", "speaker", "start_ms", "end_ms")


def bind_speakers(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    visual = VisualDocuments(spark, a.visual_json)
    return binding.bind(_speech(spark, visual, a.speech_json, a.timeline_offset_ms), visual.segments, a.min_evidence_ms, a.min_speaker_coverage, a.min_margin)


def reconcile_speakers(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    visual = VisualDocuments(spark, a.visual_json)
    spans = _speech(spark, visual, a.speech_json, a.timeline_offset_ms)
    fixes = binding.relabel(
        spans, visual.segments, visual.associations, a.min_anchor_confidence, a.min_overlap_ms, a.min_span_coverage, a.min_face_dominance
    )
    chosen = fixes.select("sid", "span_id", F.col("speaker").alias("resolved"), "face_id", "overlap_ms", "coverage", "dominance")
    changed = F.col("resolved").isNotNull()
    return spans.join(chosen, ["sid", "span_id"], "left").select(
        "sid", "span_id", F.coalesce("resolved", "speaker").alias("speaker"), F.when(changed, F.col("speaker")).alias("original_speaker"), "start_ms", "end_ms",
        "face_id", "overlap_ms", "coverage", "dominance",
    )


def classify_visibility(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    visual = VisualDocuments(spark, a.visual_json)
    speech = _speech(spark, visual, a.speech_json, a.timeline_offset_ms)
    joined = intervals.merge_intervals(speech, ["sid", "speaker"]).select("sid", "speaker", "start_ms", "end_ms")
    seen = visual.tracklets.where("face_id IS NOT NULL").join(visual.sessions, "sid")
    padded = seen.withColumn("end_ms", F.least("duration_ms", F.col("end_ms") + F.col("period_ms"))).where("end_ms > start_ms")
    coverage = intervals.merge_intervals(padded, ["sid", "face_id"]).drop("n_merged")
    cuts = read_cuts(spark, a.cuts) if a.cuts else spark.createDataFrame([], "sid string, cut_ms bigint")
    return intervals.classify_visibility(joined, visual.associations, coverage, cuts, a.occlusion_max_ms, a.boundary_tolerance_ms)


def replay_vision(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    nodes, edges = read_graph(spark, a.graph_json)
    return graph.snapshot(graph.graph_events(nodes, edges), a.start_ms, a.event_window)


def validate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rules that every visual document keeps; no row if all are kept."""
    visual = VisualDocuments(spark, a.visual_json)
    limits = visual.sessions.select("sid", "duration_ms")
    outside: Column = (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")) | (F.col("end_ms") > F.col("duration_ms"))
    confirmed = visual.associations.where("status = 'confirmed'")
    return evaluation.violations(
        evaluation.not_unique(visual.sessions, ["sid"], "one_document"),
        evaluation.not_unique(visual.tracklets, ["sid", "tracklet_id"], "tracklet_unique"),
        evaluation.not_unique(visual.segments, ["sid", "segment_id"], "segment_unique"),
        evaluation.dangling(visual.segments, visual.tracklets, ["sid", "face_id"], "segment_id", "segment_has_face"),
        evaluation.out_of_range(visual.tracklets.join(limits, "sid"), outside, "tracklet_id", "tracklet_time"),
        evaluation.out_of_range(visual.segments.join(limits, "sid"), outside, "segment_id", "segment_time"),
        evaluation.overlapping(visual.segments, ["sid", "face_id"], "segment_id", "segment_overlap"),
        evaluation.not_unique(visual.associations, ["sid", "speaker"], "one_association"),
        evaluation.not_unique(confirmed.where("face_id IS NOT NULL"), ["sid", "face_id"], "one_speaker"),
    )


def validate_graph(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rules that every graph keeps: unique ids, edges between its nodes, times in order."""
    nodes, edges = read_graph(spark, a.graph_json)
    end = lambda side: edges.select("sid", F.col(side).alias("id"), F.col("id").alias("edge"))
    return evaluation.violations(
        evaluation.not_unique(nodes, ["sid", "id"], "node_unique"), evaluation.not_unique(edges, ["sid", "id"], "edge_unique"),
        evaluation.dangling(end("source"), nodes, ["sid", "id"], "edge", "source_exists"), evaluation.dangling(end("target"), nodes, ["sid", "id"], "edge", "target_exists"),
        evaluation.out_of_range(edges, F.coalesce(F.col("end_ms") < F.col("start_ms"), F.lit(True)), "id", "edge_time"),
    )


def query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .plans.registry import QUERIES

    if a.name not in QUERIES:
        raise SystemExit(f"no query {a.name}; there are: " + ", ".join(sorted(QUERIES)))
    return QUERIES[a.name](spark, a.tables)


def parser() -> argparse.ArgumentParser:
    # Names and defaults of the parameters.
    out = argparse.ArgumentParser(prog="sessionloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(run, *paths: str, **options) -> None:
        command = commands.add_parser(run.__name__.replace("_", "-"), help=(run.__doc__ or "").strip() or None)
        for path in paths:
            command.add_argument(path)
        for name, value in options.items():
            command.add_argument("--" + name.replace("_", "-"), type=type(value) if value is not None else str, default=value)
        command.add_argument("--output")
        command.set_defaults(run=run)

    add(bind_speakers, "visual_json", "speech_json", timeline_offset_ms=0, min_evidence_ms=3000, min_speaker_coverage=0.5, min_margin=0.4)
    add(
        reconcile_speakers, "visual_json", "speech_json", timeline_offset_ms=0, min_anchor_confidence=0.7, min_overlap_ms=1200, min_span_coverage=0.6,
        min_face_dominance=0.6,
    )
    add(classify_visibility, "visual_json", "speech_json", cuts=None, timeline_offset_ms=0, occlusion_max_ms=1200, boundary_tolerance_ms=240)
    add(replay_vision, "graph_json", start_ms=0, event_window=100)
    add(validate, "visual_json")
    add(validate_graph, "graph_json")
    add(query, "name", "tables")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sessionloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = a.run(spark, a)
    if a.output:
        print(write_atomically(rows, a.output))
    else:
        rows.show(truncate=False)
    return rows
