"""Keyframes and spatial relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip, iou, region


def person_states(df: DataFrame) -> DataFrame:
    """Centre, area and regions of normalised boxes."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return df.withColumns({
        "cx": cx, "cy": cy, "area": F.col("w") * F.col("h"), "horizontal_region": region(cx, ["left", "center", "right"]),
        "vertical_region": region(cy, ["upper", "middle", "lower"]),
    })


def relations(df: DataFrame, horizontal: float = 0.08, vertical: float = 0.08, near: float = 0.35, overlap: float = 0.1) -> DataFrame:
    """Relations of every two states of a keyframe, the left one first: predicate and confidence.

    ``df``: keyframe_id, state, confidence and ``person_states`` columns. A
    relation is as certain as the less certain of the two detections, and less
    so the smaller its distance or the larger, for nearness.
    """
    w = W.partitionBy("keyframe_id").orderBy("cx", "state")
    rows = df.withColumn("n", F.row_number().over(w))
    names = ["state", "confidence", "n", "cx", "cy", "x", "y", "w", "h"]
    a = rows.select("keyframe_id", *[F.col(c).alias(f"a_{c}") for c in names])
    b = rows.select("keyframe_id", *[F.col(c).alias(f"b_{c}") for c in names])
    pairs = a.join(b, "keyframe_id").where("a_n < b_n")
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    distance, over = F.sqrt(dx * dx + dy * dy), iou(*[F.col(f"a_{c}") for c in "xywh"], *[F.col(f"b_{c}") for c in "xywh"])

    base = F.least("a_confidence", "b_confidence")
    far = lambda d: base * (0.5 + 0.5 * F.least(F.lit(1.0), d / 0.5))

    def relation(predicate: str, keep: Column, confidence: Column, swap: Column | None = None) -> Column:
        s, o = F.col("a_state"), F.col("b_state")
        subject = s if swap is None else F.when(swap, o).otherwise(s)
        target = o if swap is None else F.when(swap, s).otherwise(o)
        return F.when(keep, F.struct(F.lit(predicate).alias("predicate"), subject.alias("subject"), target.alias("object"), clip(confidence).alias("confidence")))

    found = F.array(
        relation("co_visible_with", F.lit(True), base), relation("left_of", F.abs(dx) >= horizontal, far(F.abs(dx))),
        relation("above", F.abs(dy) >= vertical, far(F.abs(dy)), dy < 0), relation("visually_close_to", distance <= near, base * (0.5 + 0.5 * (1 - distance / near))),
        relation("overlaps_in_image", over >= overlap, base * over),
    )
    return pairs.select("keyframe_id", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("keyframe_id", "r.*")


def min_max(x: str, w) -> Column:
    """Position of ``x`` between its least and largest value of the window; 1 where they are equal."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high <= low, F.lit(1.0)).otherwise((F.col(x) - low) / (high - low))


def select_keyframes(df: DataFrame, shot: list[str]) -> DataFrame:
    """Of a shot's candidate frames (frame, sharpness, faces, area): most faces, then score, then the earliest."""
    w = W.partitionBy(*shot)
    score = 0.45 * min_max("sharpness", w) + 0.35 * min_max("faces", w) + 0.2 * min_max("area", w)
    ranked = df.withColumn("score", score).withColumn("n", F.row_number().over(w.orderBy(F.desc("faces"), F.desc("score"), "frame")))
    return ranked.where("n = 1").drop("n")


def candidate_frames(shots: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Frames at 20, 50 and 80 % of each shot (half to even), and the observed frame nearest to each (the earlier of equals).

    ``shots``: keys, first, last; ``observed``: keys, frame, of the shot's own
    frames. Without observed frames only the targets come out, each frame once.
    The nearest frame is found by one pass over the shot in order.
    """
    part = F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)))
    targets = shots.select(*keys, "first", "last", part.alias("part")).select(
        *keys, F.rint(F.col("first") + F.col("part") * (F.col("last") - F.col("first"))).cast("bigint").alias("frame")
    )
    seen = F.col("frame").cast("bigint")
    line = targets.distinct().withColumn("seen", F.lit(None).cast("bigint")).unionByName(observed.select(*keys, seen.alias("frame")).distinct().withColumn("seen", F.col("frame")))
    w = W.partitionBy(*keys).orderBy("frame")
    before = F.last("seen", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0))
    after = F.first("seen", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))
    placed = line.withColumns({"before": before, "after": after}).where("seen IS NULL")
    nearest = F.when(F.col("after").isNull() | (F.col("frame") - F.col("before") <= F.col("after") - F.col("frame")), F.col("before")).otherwise(F.col("after"))
    found = placed.select(*keys, F.explode(F.array(F.col("frame"), nearest)).alias("frame"))
    return found.where("frame IS NOT NULL").distinct()


def live_region(cx: Column, cy: Column) -> Column:
    """Region of a centre on a grid of thirds, as the live path names it."""
    third = lambda v, low, high: F.when(v < 1 / 3, low).when(v > 2 / 3, high).otherwise("center")
    return F.concat_ws("-", third(cy, "top", "bottom"), third(cx, "left", "right"))
