"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Six decimals, by an arithmetic that every IEEE engine computes alike."""
    return F.floor(x * 1000000 + 0.5) / F.lit(1000000.0)


def to_ms(seconds: Column) -> Column:
    """Seconds to milliseconds, half to even."""
    return F.rint(seconds * 1000).cast("bigint")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length, at least 1e-12."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def region(value: Column, labels: list[str]) -> Column:
    """The label of the equal slice of [0, 1) that holds ``value``; 1 and beyond go to the last."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.element_at(names, F.least(F.lit(len(labels) - 1), F.floor(value * len(labels)).cast("int")) + 1)


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = w * h
    union = aw * ah + bw * bh - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / union)


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """Whole-pixel box of at least one pixel inside the frame: array of x, y, w, h."""
    left = F.least(F.lit(width - 1), F.greatest(F.lit(0), F.rint(x).cast("int")))
    top = F.least(F.lit(height - 1), F.greatest(F.lit(0), F.rint(y).cast("int")))
    right = F.least(F.lit(width), F.greatest(left + 1, F.rint(x + w).cast("int")))
    bottom = F.least(F.lit(height), F.greatest(top + 1, F.rint(y + h).cast("int")))
    return F.array(left, top, right - left, bottom - top)


def bhattacharyya(p: Column, q: Column) -> Column:
    """Distance of two histograms, by the public definition; null if one is."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    shared = F.aggregate(F.zip_with(p, q, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(total(p) * total(q))
    distance = F.sqrt(F.greatest(F.lit(0.0), 1 - F.when(scale > 0, shared / scale).otherwise(F.lit(0.0))))
    return F.when(p.isNotNull() & q.isNotNull(), distance)


def nearest_rank(values: str, p: float) -> Column:
    """Nearest-rank percentile as an aggregate; 0 over no rows."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {values})"), F.lit(0.0))
