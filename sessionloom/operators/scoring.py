"""Requests to a model behind an injected transport: batches, single retries, resumption, retry delays."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .live import _in_order
from .semantics import request_hash


class RateLimited(Exception):
    """The service asks to wait."""

    def __init__(self, message: str = "", retry_after: str | None = None):
        super().__init__(message)
        self.message, self.retry_after = message, retry_after


def retry_delay(message: str, retry_after: str | None, attempt: int) -> float:
    """Seconds to wait: the header's, else the ones the message names, else 0.5 doubled by attempt, 8 at most."""
    try:
        return max(0.0, float(retry_after))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        pass
    named = re.search(r"try again in (\d+\.?\d*|\.\d+)(ms|s)", message, re.IGNORECASE)
    if named is None:
        return min(8.0, 0.5 * 2**attempt)
    return float(named[1]) / (1000 if named[2].lower() == "ms" else 1)


def with_retries(send: Callable, attempts: int = 5, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``send`` repeated after ``RateLimited`` and network errors; OSError when attempts or patience are at an end.

    A wait longer than ``timeout`` isn't made: later runs resume from the answers kept.
    """

    def call(*args):
        for attempt in range(attempts):
            last = attempt == attempts - 1
            try:
                return send(*args)
            except RateLimited as limit:
                delay = retry_delay(limit.message, limit.retry_after, attempt)
                if last or delay > timeout:
                    raise OSError(f"rate limit: {limit.message or delay}") from None
            except (ConnectionError, TimeoutError) as error:
                if last:
                    raise OSError(f"no answer after {attempts} attempts: {error}") from None
                delay = retry_delay("", None, attempt)
            sleep(delay)
        raise OSError("no attempt was made")

    return call


def parse_reply(reply: str, expected: list[str]) -> list[dict]:
    """Analyses of a reply ``{"keyframes": [...]}``; ValueError unless its ids are the expected ones in their order."""
    try:
        found = json.loads(reply)["keyframes"]
    except (KeyError, TypeError, json.JSONDecodeError) as error:
        raise ValueError("the reply is no analysis") from error
    if not isinstance(found, list):
        raise ValueError("the reply has no keyframes array")
    ids = [x.get("keyframe_id") for x in found if isinstance(x, dict)]
    if ids != expected or len(found) != len(expected):
        raise ValueError(f"the reply's keyframes are not the request's: {ids}")
    return found


def analyse(requests: DataFrame, transport: Callable[[list[dict]], str], order: str, batch: int = 3) -> DataFrame:
    """Sends each session's keyframes in batches to ``transport``, whose answers are JSON texts.

    ``requests``: sid, keyframe_id, metadata (JSON text) and ``order``. A batch
    whose reply doesn't fit is sent again one keyframe at a time; any other
    failure, or one of a single keyframe, ends the session: its later rows are
    ``pending`` for a later run. Returns sid, keyframe_id, batch_id, analysis
    (JSON text), status (done, failed, pending) and error. Rows without a
    keyframe id take no part.
    """
    names = ("sid", "keyframe_id", "batch_id", "analysis", "status", "error")
    schema = pa.schema([("sid", pa.int64()), *[(n, pa.string()) for n in names[1:]]])

    def send(rows: list[dict]) -> list[str]:
        asked = [{**json.loads(r["metadata"] or "{}"), "keyframe_id": r["keyframe_id"]} for r in rows]
        return [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in parse_reply(transport(asked), [r["keyframe_id"] for r in rows])]

    def result(r: dict, unit: str, analysis: str | None, status: str, error: str | None = None) -> dict:
        return dict(zip(names, (r["sid"], r["keyframe_id"], unit, analysis, status, error)))

    def unit_results(rows: list[dict], unit: str) -> tuple[list[dict], bool]:
        try:
            return [result(r, unit, a, "done") for r, a in zip(rows, send(rows))], True
        except ValueError as error:
            if len(rows) == 1:
                return [result(rows[0], unit, None, "failed", str(error))], False
        except (OSError, KeyError, TypeError) as error:
            return [result(r, unit, None, "failed", str(error)) for r in rows], False
        out: list[dict] = []
        for part, r in enumerate(rows, 1):
            one = f"{unit}-part-{part:02d}"
            try:
                out.append(result(r, one, send([r])[0], "done"))
            except (OSError, ValueError, KeyError, TypeError) as error:
                out.append(result(r, one, None, "failed", str(error)))
                return out + [result(x, unit, None, "pending") for x in rows[part:]], False
        return out, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        n, open_ = 0, True

        def flush() -> list[dict]:
            nonlocal held, n, open_
            rows, held = held, []
            n += 1
            unit = f"semantic-batch-{n:05d}"
            if not open_:
                return [result(r, unit, None, "pending") for r in rows]
            out, open_ = unit_results(rows, unit)
            return out

        for one in batches:
            out: list[dict] = []
            for r in one.to_pylist():
                if held and (r["__first"] or len(held) == batch):
                    out += flush()
                if r["__first"]:
                    n, open_ = 0, True
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist(flush(), schema=schema)

    rows = requests.where("keyframe_id IS NOT NULL").select(F.col("sid").cast("bigint").alias("sid"), F.col("keyframe_id").cast("string").alias("keyframe_id"), "metadata", F.col(order).alias("__o"))
    return _in_order(rows, ["sid"], ["__o", "keyframe_id"]).mapInArrow(run, "sid long, " + ", ".join(f"{n} string" for n in names[1:]))


def cached_answers(cache: DataFrame, version: str) -> DataFrame:
    """The newest kept answer for each keyframe, from cache files that are what their names say.

    ``cache``: sid, path, modified, model, metadata (JSON text), images (array
    of hashes) and answers (array of keyframe_id, analysis). A file counts only
    if its name is the hash of its request. Of equally new ones the last by
    path is taken. Returns sid, keyframe_id, analysis, path.
    """
    hashed = request_hash(F.lit(version), F.col("model"), F.col("metadata"), F.array_join("images", ""))
    sound = cache.where(F.regexp_extract("path", r"([^/]+)\.json\z", 1) == hashed)
    each = sound.select("sid", "modified", "path", F.inline("answers")).where("keyframe_id IS NOT NULL")
    best = F.max_by(F.struct("analysis", "path"), F.struct("modified", "path")).alias("b")
    return each.groupBy("sid", "keyframe_id").agg(best).select("sid", "keyframe_id", "b.analysis", "b.path")


def session_status(results: DataFrame) -> DataFrame:
    """Whether a session's analyses are ``complete`` or ``partial``, with the counts."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = results.groupBy("sid").agg(n("done"), n("failed"), n("pending"))
    return counts.withColumn("status", F.when(F.col("failed") + F.col("pending") == 0, F.lit("complete")).otherwise(F.lit("partial")))


def frame_metadata(keyframes: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """``keyframes`` with ``visible_people``: face, speaker and regions of each known face in it, by face."""
    person = F.struct("face_id", "speaker", "horizontal_region", "vertical_region")
    seen = people.where("face_id IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list(person)).alias("visible_people"))
    none = F.array().cast("array<struct<face_id:string,speaker:string,horizontal_region:string,vertical_region:string>>")
    return keyframes.join(seen, keys, "left").withColumn("visible_people", F.coalesce("visible_people", none))


def aligned_features(features: Column, visual_frames: Column, width: int) -> Column:
    """Audio features at four a visual frame: too many are cut, too few begin again from the first, none are zeros."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), visual_frames * 4)
    again = F.transform(F.sequence(F.lit(0), visual_frames * 4 - 1), lambda i: F.get(features, i % F.size(features)))
    return F.when(visual_frames <= 0, F.slice(zeros, 1, 0)).when(F.coalesce(F.size(features), F.lit(0)) <= 0, zeros).otherwise(again)


def sampled_frames(df: DataFrame, index: str, fps: Column, sample_fps: float = 5.0) -> DataFrame:
    """Frames a scan keeps: each ``max(1, round(fps / sample_fps))``-th, with ``timestamp_ms`` (half to even)."""
    step = F.greatest(F.lit(1), F.rint(fps / sample_fps)).cast("bigint")
    return df.withColumn("timestamp_ms", F.rint(F.col(index) * 1000 / fps).cast("bigint")).where(F.col(index) % step == 0)
