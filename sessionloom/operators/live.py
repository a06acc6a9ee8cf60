"""Operators of live sessions: scene phases, online identities, binding changes, metrics, event window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import nearest_rank, r6


def _in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` by key and order in each partition, with ``__first`` on the first row of a key."""
    return df.withColumn("__first", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def spaced(df: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """Distinct times of a key, thinned in order: the first stays, then each that is ``gap`` or more after the last kept.

    Rows without a time take no part. A task streams its rows in order and
    keeps one number between batches, whatever the length of a session.
    """
    rows = df.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("bigint").alias(time)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            t = batch.column(time).to_numpy()
            first = np.flatnonzero(batch.column("__first").to_numpy(zero_copy_only=False))
            bounds = np.concatenate([[0], first[first > 0], [len(t)]])
            own, keep = set(first.tolist()), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b:
                    continue
                i = a if a in own else a + int(np.searchsorted(t[a:b], last + gap))
                while i < b:
                    keep.append(i)
                    last = int(t[i])
                    i = max(i + 1, a + int(np.searchsorted(t[a:b], last + gap)))
            yield batch.take(pa.array(keep, pa.int64())).drop_columns(["__first"])

    return _in_order(rows, keys, [time]).mapInArrow(run, rows.schema)


def scene_phases(
    frames: DataFrame, keys: list[str], time: str, distance: str, threshold: float = 0.45, min_scene_ms: int = 1000, keyframe_ms: int = 30_000
) -> DataFrame:
    """Keyframes of a live session, with the scene each one starts or samples.

    A scene starts at the first frame, and at a frame whose ``distance`` to the
    one before is at least ``threshold``, ``min_scene_ms`` or more after the
    scene's start; within a scene a frame is sampled ``keyframe_ms`` or more
    after its last keyframe. Returns keys, time, scene (from 1), event
    (scene_changed or scene_sampled), start_ms and end_ms of the scene (the
    start of the next; null: the last one).
    """
    w = W.partitionBy(*keys).orderBy(time)
    rows = frames.groupBy(*keys, time).agg(F.max(distance).alias("__d")).withColumn("__p", F.row_number().over(w))
    starts = spaced(rows.where((F.col("__p") == 1) | (F.col("__d") >= threshold)), keys, time, min_scene_ms)
    scenes = starts.select(
        *keys, F.col(time).alias("start_ms"), F.row_number().over(w).alias("scene"), F.lead(time).over(w).alias("end_ms")
    )
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    at = rows.alias("f").join(scenes.alias("s"), [*same, F.col(f"f.{time}") == F.col("s.start_ms")], "left")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    placed = at.select(*[F.col(f"f.{k}").alias(k) for k in keys], F.col(f"f.{time}").alias(time), "scene", "start_ms", "end_ms")
    scene = F.last("scene", ignorenulls=True).over(upto).alias("scene")
    kept = spaced(placed.select(*keys, time, scene), [*keys, "scene"], time, keyframe_ms)
    both = [F.col(f"k.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "scene"]]
    return kept.alias("k").join(scenes.alias("s"), both).select(
        *[F.col(f"k.{k}").alias(k) for k in keys], F.col(f"k.{time}").alias(time), F.col("k.scene").alias("scene"),
        F.when(F.col(f"k.{time}") == F.col("s.start_ms"), F.lit("scene_changed")).otherwise(F.lit("scene_sampled")).alias("event"),
        F.col("s.start_ms").alias("start_ms"), F.col("s.end_ms").alias("end_ms"),
    )


def adaptive_cuts(
    df: DataFrame, keys: list[str], time: str, content: str, threshold: float = 3.0, least: float = 15.0, min_len: int = 500, radius: int = 2
) -> DataFrame:
    """Frames whose content value stands out from its neighbours.

    The ratio is the value over the mean of the ``radius`` frames on either
    side (255 at most; over a mean of nothing 255 if the value is at least
    ``least``, else 0); frames without all their neighbours are no cuts. A cut
    needs ``threshold`` and ``least``, and ``min_len`` after the session's first
    frame or the cut before.
    """
    w = W.partitionBy(*keys).orderBy(time)
    near = w.rowsBetween(-radius, radius)
    total, n = F.sum(content).over(near), F.count(content).over(near)
    mean = (total - F.col(content)) / (2 * radius)
    value = F.col(content)
    ratio = F.when(mean.between(-1e-5, 1e-5), F.when(value >= least, F.lit(255.0)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(255.0), value / mean))
    marked = df.select(*keys, time, content, ratio.alias("__r"), n.alias("__n"), (F.row_number().over(w) == 1).alias("__1"))
    found = (F.col("__n") == 2 * radius + 1) & (F.col("__r") >= threshold) & (value >= least)
    kept = spaced(marked.where(F.col("__1") | found), keys, time, min_len)
    return kept.withColumn("__c", F.row_number().over(w)).where("__c > 1").drop("__c")


def online_faces(
    tracked: DataFrame, threshold: float = 0.45, min_observations: int = 3, max_people: int = 4, max_gap: int = 10
) -> DataFrame:
    """Faces of online tracks, frame by frame.

    ``tracked``: sid, frame, det, track, embedding. A track without a face that
    has been seen ``min_observations`` times takes the most similar face of at
    least ``threshold`` (the later one of equals) that no track of the frame
    has; without one it founds a face, of ``max_people`` at most. A face's
    profile is the running mean of its detections. Returns sid, frame, det,
    track, face_id (null: none yet). Frames of a session are streamed in order;
    tracks are forgotten ``max_gap`` frames after their last detection.
    """

    def unit(v: np.ndarray) -> np.ndarray:
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def settle(rows: list[dict], tracks: dict, profiles: dict) -> list[dict]:
        now = rows[0]["frame"]
        for old in [k for k, v in tracks.items() if now - v["seen"] > max_gap]:
            del tracks[old]
        for r in rows:
            v = unit(np.asarray(r["embedding"], dtype=float))
            own = tracks.setdefault(r["track"], {"n": 0, "mean": np.zeros_like(v), "face": None})
            own["mean"] = unit(own["mean"] * own["n"] + v)
            own["n"], own["seen"] = own["n"] + 1, now
            r["unit"] = v
        taken = {tracks[r["track"]]["face"] for r in rows}
        for r in rows:
            own = tracks[r["track"]]
            if own["face"] is None and own["n"] >= min_observations:
                free = [(float(own["mean"] @ mean), i, face) for i, (face, (mean, _)) in enumerate(profiles.items()) if face not in taken]
                best = max((f for f in free if f[0] >= threshold), default=None)
                if best is not None:
                    own["face"] = best[2]
                elif len(profiles) < max_people:
                    own["face"] = f"Face-{len(profiles) + 1:02d}"
                    profiles[own["face"]] = (own["mean"], 1)
                taken.add(own["face"])
            if own["face"] is not None:
                mean, n = profiles[own["face"]]
                profiles[own["face"]] = (unit(mean * n + r["unit"]), n + 1)
        return [{"sid": r["sid"], "frame": now, "det": r["det"], "track": r["track"], "face_id": tracks[r["track"]]["face"]} for r in rows]

    schema = pa.schema([("sid", pa.int64()), ("frame", pa.int64()), ("det", pa.int64()), ("track", pa.int64()), ("face_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        tracks: dict = {}
        profiles: dict = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and (r["__first"] or r["frame"] != held[0]["frame"]):
                    out += settle(held, tracks, profiles)
                    held = []
                if r["__first"]:
                    tracks, profiles = {}, {}
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist(settle(held, tracks, profiles), schema=schema)

    rows = tracked.where("embedding IS NOT NULL").select(*[F.col(c).cast("bigint").alias(c) for c in ("sid", "frame", "det", "track")], "embedding")
    return _in_order(rows, ["sid"], ["frame", "det", "track"]).mapInArrow(run, "sid long, frame long, det long, track long, face_id string")


def _before(keys: list[str], order: str):
    w = W.partitionBy(*keys, "speaker").orderBy(order)
    face, status = F.lag("face_id").over(w), F.lag("status").over(w)
    lost = (status == "confirmed") & (~F.col("face_id").eqNullSafe(face) | ~F.col("status").eqNullSafe(F.lit("confirmed")))
    return w, face, status, F.coalesce(lost, F.lit(False))


def binding_transitions(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Changes of what each speaker is bound to over repeated evaluations.

    ``states``: a row for each evaluation and speaker, with face_id and status.
    Rows whose face and status equal the ones before are left out. Returns keys,
    order, speaker, face_id, status, emitted (an identity candidate is
    announced), superseded_face (the confirmed face given up, else null) and
    edge_no (how many identity edges the speaker has had so far).
    """
    w, face, status, lost = _before(keys, order)
    changed = (F.row_number().over(w) == 1) | ~F.col("face_id").eqNullSafe(face) | ~F.col("status").eqNullSafe(status)
    emitted = F.coalesce((F.col("status") == "confirmed") & F.col("face_id").isNotNull(), F.lit(False))
    marked = states.select(*keys, order, "speaker", "face_id", "status", emitted.alias("emitted"), F.when(lost, face).alias("superseded_face"), changed.alias("__c"))
    edges = F.count_if("emitted").over(W.partitionBy(*keys, "speaker").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return marked.where("__c").drop("__c").withColumn("edge_no", edges)


def speaker_labels(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Label of each face's speaking segments after all evaluations: keys, face_id, speaker (null: cleared).

    A confirmed binding labels its face's segments; one that is given up clears
    the labels of the face it had, also another speaker's. Evaluations act in
    order, speakers within one by name.
    """
    _, face, _, lost = _before(keys, order)
    steps = F.array(
        F.struct(F.when(lost, face).alias("face_id"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("step")),
        F.struct(F.when(F.col("status") == "confirmed", F.col("face_id")).alias("face_id"), F.col("speaker").alias("label"), F.lit(1).alias("step")),
    )
    acts = states.select(*keys, F.col(order).alias("__o"), "speaker", steps.alias("__s")).select(*keys, "__o", F.col("speaker").alias("__w"), F.inline("__s")).where("face_id IS NOT NULL")
    last = F.max_by(F.struct("label"), F.struct("__o", "__w", "step"))
    return acts.groupBy(*keys, "face_id").agg(last.alias("__l")).select(*keys, "face_id", F.col("__l.label").alias("speaker"))


def frame_metrics(df: DataFrame, keys: list[str], order: list, latency: str, lag: str, recent: int = 1000) -> DataFrame:
    """Metrics of processed frames: count, mean and largest latency, p50 and p95 of the last ``recent`` frames, largest lag (0 at least)."""
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    late = f"CASE WHEN __r <= {int(recent)} THEN `{latency}` END"
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sampled_frames"), r6(F.avg(latency)).alias("mean_latency"), nearest_rank(late, 0.5).alias("p50_recent"),
        nearest_rank(late, 0.95).alias("p95_recent"), F.max(latency).alias("max_latency"), F.greatest(F.lit(0), F.max(lag)).alias("max_lag"),
    )


def event_window(events: DataFrame, keys: list[str], sequence: str, most: int = 100) -> DataFrame:
    """The last ``most`` events of a session, as its bounded buffer holds them."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(sequence)))
    return events.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")
