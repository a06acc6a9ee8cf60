"""Incremental operators: the speaking state machine and sliding context windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP_MS = 40
PHASES = "sid long, face_id string, t long, phase string"
#: speaking: a phase is open; voiced: start of the running speech; unvoiced: start of the running silence; until: how far the key was seen.
STATE = "speaking boolean, voiced long, unvoiced long, until long"
SILENT = (False, None, None)


class SpeakingPhases:
    """Samples of one face to started, continued and ended, a chunk of time after the other.

    A silent face starts to speak once speaking samples without any other
    between them reach ``confirm_ms``, at the first of them; a chunk without
    samples interrupts them. A speaking face falls silent where its silence
    began, once that lies ``silence_ms`` before the end of the chunk at hand;
    what a chunk has no samples for at its end is silence. A chunk in which an
    open phase goes on is reported at its first speaking sample.
    """

    def __init__(self, confirm_ms: int = 200, silence_ms: int = 1000, step_ms: int = STEP_MS):
        if confirm_ms < step_ms or silence_ms < step_ms:
            raise ValueError("durations are at least one step")
        self.confirm_ms, self.silence_ms, self.step_ms = confirm_ms, silence_ms, step_ms

    def advance(self, state: tuple, samples: list[tuple[int, bool]], start_ms: int, end_ms: int) -> tuple[tuple, list[tuple[int, str]]]:
        """The state after the samples of [start_ms, end_ms), and the phases on the way. At equal times a speaking sample wins."""
        speaking, voiced, unvoiced = state
        at: dict[int, bool] = {}
        for t, on in samples:
            if start_ms <= t < end_ms:
                at[t] = at.get(t, False) or on
        line = sorted(at.items())
        if speaking:
            rest = max(start_ms, line[-1][0] + self.step_ms) if line else start_ms
            if rest < end_ms:
                line.append((rest, False))
        elif not line:
            voiced = None
        out: list[tuple[int, str]] = []
        for t, on in line:
            if on:
                unvoiced = None
                if not speaking:
                    voiced = t if voiced is None else voiced
                    if min(end_ms, t + self.step_ms) - voiced >= self.confirm_ms:
                        speaking = True
                        out.append((voiced, "started"))
            else:
                voiced = None
                if speaking:
                    unvoiced = t if unvoiced is None else unvoiced
                    if end_ms - unvoiced >= self.silence_ms:
                        out.append((unvoiced, "ended"))
                        speaking, unvoiced = False, None
        first = next((t for t, on in line if on), None)
        if speaking and first is not None and not out:
            out.append((first, "continued"))
        rank = {"ended": 0, "started": 1, "continued": 2}
        return (speaking, voiced, unvoiced), sorted(out, key=lambda x: (x[0], rank[x[1]]))


def speaking_stream(
    samples: DataFrame, confirm_ms: int = 200, silence_ms: int = 1000, step_ms: int = STEP_MS, chunk_ms: int = 1000, watermark: str = "10 seconds"
) -> DataFrame:
    """Phases of a stream of sid, face_id, t (ms), speaking (boolean), ts (timestamp of t).

    Chunks are the multiples of ``chunk_ms``, so that the phases don't depend on
    how the stream falls into batches. State is one row for each face that
    speaks or is about to; a silent face has none. Silence without further
    samples is noticed by an event-time timer.
    """
    machine = SpeakingPhases(confirm_ms, silence_ms, step_ms)

    def chunks(held: tuple, until: int, rows: list[tuple[int, bool]], end: int) -> tuple[tuple, int, list[tuple[int, str]]]:
        """Whole chunks from ``until`` to ``end``; empty ones only as long as the state hears them."""
        out: list[tuple[int, str]] = []
        by: dict[int, list[tuple[int, bool]]] = {}
        for t, on in rows:
            by.setdefault(t // chunk_ms, []).append((t, on))
        n, last = until // chunk_ms, end // chunk_ms
        while n < last:
            if n not in by and tuple(held) == SILENT:
                n = min([k for k in by if k >= n], default=last)
                continue
            held, found = machine.advance(held, by.get(n, []), n * chunk_ms, (n + 1) * chunk_ms)
            out += found
            n += 1
        return held, last * chunk_ms, out

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, until = state.get if state.exists else (*SILENT, None)
        if state.hasTimedOut:
            held, until, found = chunks(tuple(held), until, [], state.getCurrentWatermarkMs())
        else:
            rows = [(int(t), bool(on)) for b in batches for t, on in zip(b["t"], b["speaking"], strict=True)]
            first, end = min(t for t, _ in rows), max(t for t, _ in rows) + step_ms
            until = first // chunk_ms * chunk_ms if until is None else until
            held, until, found = chunks(tuple(held), until, rows, -(-end // chunk_ms) * chunk_ms)
        if tuple(held) == SILENT:
            if state.exists:
                state.remove()
        else:
            state.update((*held, until))
            state.setTimeoutTimestamp(max(until + silence_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, t, p) for t, p in found], columns=["sid", "face_id", "t", "phase"])

    return (
        samples.withWatermark("ts", watermark).groupBy("sid", "face_id")
        .applyInPandasWithState(update, PHASES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def context_windows(samples: DataFrame, size: str = "4 seconds", hop: str = "1 second", watermark: str = "0 seconds") -> DataFrame:
    """Sliding windows of a stream of sid, face_id, ts: context counts, and those of the newest hop (published once)."""
    w = F.window("ts", size, hop)
    newest = F.col("ts") >= F.col("window.end") - F.expr(f"INTERVAL {hop}")
    return (
        samples.withWatermark("ts", watermark).withColumn("window", w).groupBy("sid", "window")
        .agg(F.count(F.lit(1)).alias("n_context"), F.count_if(newest).alias("n_published"))
        .select("sid", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_context", "n_published")
    )


def upsert_edges(edges: DataFrame) -> DataFrame:
    """Streaming upsert of graph edges (update mode): widest range, best confidence, count."""
    return edges.groupBy("sid", "source", "predicate", "target").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")
    )


def newest_tasks(batch: DataFrame, keys: list[str], order: str, queue: int) -> tuple[DataFrame, DataFrame]:
    """Drop-oldest admission of a micro-batch: the newest ``queue`` tasks of each key, and those dropped."""
    from pyspark.sql import Window as W

    ranked = batch.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order))))
    return ranked.where(F.col("__n") <= queue).drop("__n"), ranked.where(F.col("__n") > queue).drop("__n")
