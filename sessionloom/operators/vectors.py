"""Vector similarity, tracking and clustering."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import bhattacharyya, cosine, iou


def similar_pairs(df: DataFrame, keys: list[str], node: str, vector: str) -> DataFrame:
    """Cosine of every two rows of equal ``keys``: a < b."""
    left = df.select(*keys, F.col(node).alias("a"), F.col(vector).alias("x"))
    right = df.select(*keys, F.col(node).alias("b"), F.col(vector).alias("y"))
    return left.join(right, keys).where("a < b").select(*keys, "a", "b", cosine(F.col("x"), F.col("y")).alias("similarity"))


def weighted_centroid(df: DataFrame, keys: list[str], vector: str, weight: str, least: float = 0.05) -> DataFrame:
    """Per dimension, the sum of components times weight and the total weight."""
    w = F.greatest(F.lit(least), F.col(weight))
    parts = df.select(*keys, w.alias("__w"), F.posexplode(vector).alias("dim", "__v"))
    return parts.groupBy(*keys, "dim").agg(F.sum(F.col("__v").cast("double") * F.col("__w")).alias("total"), F.sum("__w").alias("weight"))


def representatives(df: DataFrame, keys: list[str], node: str, quality: str) -> DataFrame:
    """The node of best quality, the smallest of equals."""
    w = W.partitionBy(*keys).orderBy(F.desc(quality), F.col(node))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, F.col(node).alias("representative"), quality)


def cooccurring(df: DataFrame, keys: list[str], track: str, time: str, tolerance: int) -> DataFrame:
    """Pairs of tracks seen within ``tolerance`` of each other: a band join on time buckets."""
    width = max(1, tolerance)
    a = df.select(*keys, F.col(track).alias("a"), F.col(time).alias("ta"), F.explode(F.sequence(F.floor((F.col(time) - tolerance) / width), F.floor((F.col(time) + tolerance) / width))).alias("__b"))
    b = df.select(*keys, F.col(track).alias("b"), F.col(time).alias("tb"), F.floor(F.col(time) / width).alias("__b"))
    return a.join(b, [*keys, "__b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= tolerance)).select(*keys, "a", "b").distinct()


def bridged_fragments(obs: DataFrame, period_ms: int, short: int = 5, long: int = 6, least_iou: float = 0.35) -> DataFrame:
    """Short tracks inside a longer one: both its neighbours in time lie near and overlap the fragment's ends.

    ``obs``: sid, track, t, x, y, w, h. Returns sid, fragment, target, score.
    Fragments meet the observations of longer tracks in time buckets.
    """
    sizes = obs.groupBy("sid", "track").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    box = F.struct("t", "x", "y", "w", "h")
    ends = obs.groupBy("sid", "track").agg(F.min(box).alias("first"), F.max(box).alias("last"))
    fragments = sizes.where(F.col("n") <= short).join(ends, ["sid", "track"]).select("sid", F.col("track").alias("fragment"), "lo", "hi", "first", "last")
    targets = obs.join(sizes.where(F.col("n") >= long).select("sid", "track"), ["sid", "track"])
    reach, width = 2 * period_ms, max(1, 8 * period_ms)
    bucket = lambda c: F.floor(c / width)
    near = fragments.withColumn("__b", F.explode(F.sequence(bucket(F.col("lo") - reach), bucket(F.col("hi") + reach))))
    points = targets.select("sid", F.col("track").alias("target"), box.alias("o"), F.col("t"), bucket(F.col("t")).alias("__b"))
    met = near.join(points, ["sid", "__b"]).where(F.col("t").between(F.col("lo") - reach, F.col("hi") + reach))
    sides = met.groupBy("sid", "fragment", "target", "first", "last").agg(
        F.max(F.when(F.col("t") < F.col("lo"), F.col("o"))).alias("before"), F.min(F.when(F.col("t") > F.col("hi"), F.col("o"))).alias("after")
    )
    over = lambda p, q: iou(*[F.col(f"{p}.{c}") for c in "xywh"], *[F.col(f"{q}.{c}") for c in "xywh"])
    scored = sides.where("before IS NOT NULL AND after IS NOT NULL").withColumn("score", F.least(over("before", "first"), over("last", "after")))
    w = W.partitionBy("sid", "fragment").orderBy(F.desc("score"), "target")
    return scored.where(F.col("score") >= least_iou).withColumn("n", F.row_number().over(w)).where("n = 1").select("sid", "fragment", "target", "score")


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of a rectangular matrix, by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    a = cost.T if flip else cost
    n, m = a.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0] = i
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        j = 0
        while True:
            used[j] = True
            row = match[j]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = a[row - 1, free - 1] - u[row] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j
            nxt = free[np.argmin(least[free])]
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) for i, j in pairs) if flip else sorted(pairs)


def _box_iou(a: np.ndarray, b: np.ndarray) -> float:
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def track(detections: DataFrame, max_gap: int, reid: float = 0.75, greedy: bool = False) -> DataFrame:
    """Detections of a session to tracks, frame by frame.

    ``detections``: sid, frame, det, box (x, y, w, h), embedding, and quality
    where it is known: a track's embedding is the mean of its detections'
    weighted by quality, 0.05 at least (1 where it isn't known). A track may
    take a detection if their similarity is at least 0.25 and either their
    boxes overlap by 0.2 or the similarity reaches ``reid``; the cheapest
    assignment of a frame wins (``greedy``: the cheapest pair first). Returns
    sid, frame, det and track (from 1). A session is one task: its frames
    depend on each other.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "det"], kind="stable")
        last_frame: list[int] = []
        boxes: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        out = []
        for frame, rows in pdf.groupby("frame", sort=True):
            dets = np.stack([np.asarray(e, dtype=float) for e in rows["embedding"]])
            dets = dets / np.maximum(np.linalg.norm(dets, axis=1), 1e-12)[:, None]
            weights = np.maximum(0.05, rows["quality"].to_numpy(dtype=float)) if "quality" in rows else np.ones(len(dets))
            found = [np.asarray(b, dtype=float) for b in rows["box"]]
            live = [i for i, f in enumerate(last_frame) if frame - f <= max_gap]
            chosen: dict[int, int] = {}
            if live:
                cost = np.full((len(live), len(dets)), 1e6)
                own = np.stack([sums[i] for i in live])
                similar = (own / np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]) @ dets.T
                for (k, i), d in itertools.product(enumerate(live), range(len(dets))):
                    sim = float(similar[k, d])
                    if sim < 0.25:
                        continue
                    over = _box_iou(boxes[i], found[d])
                    if sim >= 0.25 and (over >= 0.2 or sim >= reid):
                        cost[k, d] = 0.65 * (1 - sim) + 0.3 * (1 - over) + 0.05 * (frame - last_frame[i]) / max(max_gap, 1)
                if greedy:
                    pairs, rows_used, cols_used = [], set(), set()
                    for _, k, d in sorted((cost[k, d], k, d) for k in range(len(live)) for d in range(len(dets))):
                        if k not in rows_used and d not in cols_used:
                            pairs.append((k, d))
                            rows_used.add(k)
                            cols_used.add(d)
                else:
                    pairs = hungarian(cost)
                chosen = {d: live[k] for k, d in pairs if cost[k, d] < 1e6}
            for d in range(len(dets)):
                i = chosen.get(d)
                if i is None:
                    i = len(last_frame)
                    last_frame.append(frame)
                    boxes.append(found[d])
                    sums.append(np.zeros(dets.shape[1]))
                last_frame[i], boxes[i] = frame, found[d]
                sums[i] = sums[i] + weights[d] * dets[d]
                out.append((rows["sid"].iloc[0], frame, rows["det"].iloc[d], i + 1))
        return pd.DataFrame(out, columns=["sid", "frame", "det", "track"])

    return detections.groupBy("sid").applyInPandas(run, "sid long, frame long, det long, track long")


def agglomerate(tracks: DataFrame, conflicts: DataFrame, threshold: float) -> DataFrame:
    """Constrained centroid clustering of a session's tracks.

    ``tracks``: sid, track, start_ms, weight, embedding; ``conflicts``: sid, a,
    b that may not join. The most similar allowed pair of clusters joins until
    none reaches ``threshold`` (ties: the first pair). Clusters are numbered by
    earliest start. Returns sid, track, face.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"sid": [], "track": [], "face": []}).astype("int64")
        left = left.sort_values(["start_ms", "track"], kind="stable")
        ids, starts = left["track"].tolist(), left["start_ms"].tolist()
        units = [np.asarray(e, dtype=float) for e in left["embedding"]]
        sums = [w * e / max(float(np.linalg.norm(e)), 1e-12) for w, e in zip(left["weight"], units, strict=True)]
        members = [[i] for i in range(len(ids))]
        place = {t: i for i, t in enumerate(ids)}
        apart = np.zeros((len(ids), len(ids)), dtype=bool)
        for a, b in zip(right["a"], right["b"], strict=True):
            if a in place and b in place:
                apart[place[a], place[b]] = apart[place[b], place[a]] = True
        while len(members) > 1:
            m = np.stack([s / max(float(np.linalg.norm(s)), 1e-12) for s in sums])
            sim = np.round(m @ m.T, 12)
            sim[np.tril_indices(len(members))] = -2
            sim[apart] = -2
            best = int(np.argmax(sim))
            i, j = divmod(best, len(members))
            if sim[i, j] < threshold:
                break
            members[i] += members.pop(j)
            sums[i] = sums[i] + sums.pop(j)
            apart[i] |= apart[j]
            apart[:, i] |= apart[:, j]
            apart = np.delete(np.delete(apart, j, 0), j, 1)
        order = sorted(range(len(members)), key=lambda c: (min(starts[i] for i in members[c]), min(members[c])))
        rows = [(left["sid"].iloc[0], ids[i], n + 1) for n, c in enumerate(order) for i in members[c]]
        return pd.DataFrame(rows, columns=["sid", "track", "face"])

    return tracks.groupBy("sid").cogroup(conflicts.groupBy("sid")).applyInPandas(run, "sid long, track long, face long")


def leaders(df: DataFrame, threshold: float) -> DataFrame:
    """Leader clustering of histograms in order: sid, item, histogram -> sid, item, leader, distance.

    An item joins the nearest leader within ``threshold`` or becomes one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        kept: list[tuple[int, np.ndarray]] = []
        rows = []
        for item, hist in zip(pdf["item"], pdf["histogram"], strict=True):
            h = np.asarray(hist, dtype=float)
            best = min(((_bhattacharyya(h, k), n, who) for n, (who, k) in enumerate(kept)), default=None)
            if best is not None and best[0] <= threshold:
                rows.append((pdf["sid"].iloc[0], item, best[2], round(best[0], 6)))
            else:
                kept.append((item, h))
                rows.append((pdf["sid"].iloc[0], item, item, 0.0))
        return pd.DataFrame(rows, columns=["sid", "item", "leader", "distance"])

    return df.groupBy("sid").applyInPandas(run, "sid string, item long, leader long, distance double")


def _bhattacharyya(p: np.ndarray, q: np.ndarray) -> float:
    scale = np.sqrt(p.sum() * q.sum())
    return float(np.sqrt(max(0.0, 1 - np.sqrt(p * q).sum() / scale))) if scale > 0 else 1.0


def histogram_cuts(df: DataFrame, keys: list[str], time: str, histogram: str, threshold: float = 0.45) -> DataFrame:
    """Frames whose histogram lies at least ``threshold`` from the one before."""
    w = W.partitionBy(*keys).orderBy(time)
    marked = df.withColumn("distance", bhattacharyya(F.lag(histogram).over(w), F.col(histogram)))
    return marked.where(F.col("distance") >= threshold)


def strongest_cuts(df: DataFrame, keys: list[str], time: str, strength: str, window_ms: int = 300) -> DataFrame:
    """Non-maximum suppression in order: within ``window_ms`` of the last kept cut the stronger one stays."""
    point = F.struct(F.col(time).alias("t"), F.col(strength).alias("s"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("all"))
    kept = F.aggregate(
        "all", F.slice("all", 1, 0),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x))
        .when(x["t"] - F.element_at(acc, -1)["t"] > window_ms, F.concat(acc, F.array(x)))
        .when(x["s"] > F.element_at(acc, -1)["s"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x)))
        .otherwise(acc),
    )
    return grouped.select(*keys, F.explode(kept).alias("c")).select(*keys, F.col("c.t").alias(time), F.col("c.s").alias(strength))
