"""Temporal scene and conversation graphs, their events and replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..functions.text import bigrams, jaccard_distinct, object_key
from .intervals import overlap_join
from .live import _in_order


def unit_similarity(category: tuple[Column, Column], text: tuple[Column, Column], objects: tuple[Column, Column], faces: tuple[Column, Column]) -> Column:
    """0 across categories; else 0.55 description + 0.30 objects + 0.15 faces, by Jaccard of arrays of distinct values."""
    score = 0.55 * jaccard_distinct(*text) + 0.3 * jaccard_distinct(*objects) + 0.15 * jaccard_distinct(*faces)
    return F.when(category[0] == category[1], score).otherwise(F.lit(0.0))


def units(analyses: DataFrame) -> DataFrame:
    """Analyses with description bigrams and object keys, in order of time."""
    return analyses.withColumns({"grams": bigrams(F.col("description")), "keys": F.array_distinct(F.transform("objects", object_key)), "faces": F.array_distinct("faces")})


#: Rows of a slice, and the most slices of a session.
SLICE_ROWS, SLICES = 1000, 512


def sliced(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` dealt to slices of time of their session, so that no task holds a whole one.

    ``rows``: sid, start_ms, keyframe_id and others. Adds ``__p``, the slice
    (in order of time), and ``__ghost``: each slice but the first begins with a
    copy of the last row before it, which is true there. A window over sid and
    ``__p`` finds the row before in it; ghosts are left out afterwards.

    The limits are approximate quantiles, so they are written once; any limits
    give the same result. There is at most one for each ``slice_rows`` rows,
    which is why they are broadcast.
    """
    from ..sources.documents import checkpointed

    light = rows.select("sid", "start_ms", "keyframe_id")
    shares = [k / SLICES for k in range(1, SLICES)]
    sizes = light.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("start_ms", shares).alias("q")).where(F.col("n") > slice_rows)
    k = F.least(F.lit(SLICES), F.ceil(F.col("n") / slice_rows)).cast("int")
    limits = F.array_distinct(F.transform(F.sequence(F.lit(1), k - 1), lambda j: F.get("q", (j * SLICES / k).cast("int") - 1)))
    bounds = F.broadcast(checkpointed(sizes.select("sid", limits.alias("__q")), "slices"))
    place = F.size(F.filter("__q", lambda q: q < F.col("start_ms")))
    last = light.join(bounds, "sid").groupBy("sid", place.alias("__p")).agg(F.max(F.struct("start_ms", "keyframe_id")).alias("__last"))
    ends = last.withColumn("__next", F.lead("__p").over(W.partitionBy("sid").orderBy("__p"))).where("__next IS NOT NULL")
    own = rows.join(bounds, "sid", "left").withColumn("__p", F.when(F.col("__q").isNull(), F.lit(0)).otherwise(place)).drop("__q")
    met = own.join(F.broadcast(ends), ["sid", "__p"], "left")
    ghost = F.struct("start_ms", "keyframe_id") == F.col("__last")
    here, there = F.struct(F.col("__p").alias("p"), F.lit(False).alias("ghost")), F.struct(F.col("__next").alias("p"), F.lit(True).alias("ghost"))
    dealt = met.withColumn("__x", F.explode(F.when(ghost, F.array(here, there)).otherwise(F.array(here))))
    return dealt.select(*rows.columns, F.col("__x.p").alias("__p"), F.col("__x.ghost").alias("__ghost")).repartition("sid", "__p")


def merge_adjacent(analyses: DataFrame, threshold: float = 0.2, columns: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``group``: neighbouring units in time of one category and at least ``threshold`` similar share it.

    Returns ``columns`` of the units (all by default), similarity and group.
    Rows are compared within slices of a session; they are written once, with
    the number of groups that begin in their slice, to which the groups of the
    slices before are added.
    """
    from ..sources.documents import checkpointed

    w = W.partitionBy("sid", "__p").orderBy("start_ms", "keyframe_id")
    prev = lambda c: F.lag(c).over(w)
    u = units(sliced(analyses, slice_rows))
    columns = columns or [c for c in u.columns if not c.startswith("__")]
    u = u.withColumns({f"p_{c}": prev(c) for c in ("category", "grams", "keys", "faces")})
    pair = lambda c: (F.col(f"p_{c}"), F.col(c))
    u = u.withColumn("similarity", F.coalesce(unit_similarity(pair("category"), pair("grams"), pair("keys"), pair("faces")), F.lit(0.0)))
    fresh = F.when(F.col("__ghost") | ((F.col("p_category") == F.col("category")) & (F.col("similarity") >= threshold)), 0).otherwise(1)
    u = u.withColumn("__f", fresh).withColumn("__g", F.sum("__f").over(w.rowsBetween(W.unboundedPreceding, 0))).where("NOT __ghost")
    marked = checkpointed(u.select(*columns, "similarity", "__p", "__g"), "units")
    counts = marked.groupBy("sid", "__p").agg(F.max("__g").alias("n"))
    before = F.sum("n").over(W.partitionBy("sid").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)).alias("__before")
    offsets = F.broadcast(counts.select("sid", "__p", before).where("__before IS NOT NULL"))
    placed = marked.join(offsets, ["sid", "__p"], "left")
    return placed.select(*columns, "similarity", (F.col("__g") + F.coalesce("__before", F.lit(0))).alias("group"))


def bridge_views(groups: DataFrame, max_ms: int = 30_000) -> DataFrame:
    """Merge a group, a short one after it and the next, where the outer two share a source view; until none is left.

    ``groups``: sid, keyframe_id, group, category, view, start_ms, end_ms.
    Returns sid, keyframe_id, group (from 1). The scan starts again at the left
    after each merge. No merge crosses two categories or two long groups side
    by side (a merge needs one category and a short group in the middle, and
    groups only grow), so a session falls into pieces that are scanned alone.
    A task streams one row for each group and holds those of one piece.
    """
    at = F.struct("start_ms", "keyframe_id")
    view = F.coalesce(F.col("view").cast("string"), F.lit("\0"))
    one = groups.groupBy("sid", "group").agg(
        F.min_by("category", at).alias("category"), F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.collect_set(view).alias("views")
    )
    w = W.partitionBy("sid").orderBy("group")
    one = one.withColumn("short", (F.col("n") <= 2) & (F.col("ms") <= max_ms))
    joins = F.lag("group").over(w).isNotNull() & F.lag("category").over(w).eqNullSafe(F.col("category")) & (F.col("short") | F.lag("short").over(w))
    one = one.withColumn("__f", F.when(joins, 0).otherwise(1)).withColumn("piece", F.sum("__f").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, set, list]] = []  # n, ms, views and groups
        sid = None
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("sid", "group", "n", "ms", "views", "__first")]):
                if row[-1]:
                    done += [(sid, g, x[3][0]) for x in held for g in x[3]]
                    held, sid = [], row[0]
                held.append((row[2], row[3], set(row[4]), [row[1]]))
                while len(held) >= 3 and held[-2][0] <= 2 and held[-2][1] <= max_ms and held[-3][2] & held[-1][2]:
                    parts = held[-3:]
                    held[-3:] = [(sum(x[0] for x in parts), sum(x[1] for x in parts), set().union(*[x[2] for x in parts]), [g for x in parts for g in x[3]])]
            yield out(done)
        yield out([(sid, g, x[3][0]) for x in held for g in x[3]])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["__s", "__g", "head"])

    light = one.select(F.col("sid").cast("string").alias("sid"), "piece", F.col("group").cast("bigint").alias("group"), "n", "ms", "views")
    heads = _in_order(light, ["sid", "piece"], ["group"]).mapInArrow(run, "__s string, __g long, head long")
    number = F.sum(F.when(F.col("head") == F.col("__g"), 1).otherwise(0)).over(W.partitionBy("__s").orderBy("__g").rowsBetween(W.unboundedPreceding, 0))
    found = heads.select("__s", "__g", number.alias("__n"))
    rows = groups.select(F.col("sid").cast("string").alias("sid"), F.col("keyframe_id").cast("bigint").alias("keyframe_id"), F.col("group").cast("bigint").alias("group"))
    return rows.join(found, F.col("sid").eqNullSafe(F.col("__s")) & (F.col("group") == F.col("__g"))).select("sid", "keyframe_id", F.col("__n").alias("group"))


def scene_nodes(grouped: DataFrame) -> DataFrame:
    """One node for each group: label of its first unit, time range, keyframes and faces in order."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "keyframe_id", c))), lambda x: x[c])
    return grouped.groupBy("sid", F.col("group").alias("scene_id")).agg(
        F.min_by("description", F.struct("start_ms", "keyframe_id")).alias("label"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "keyframe_id"))), lambda x: x["keyframe_id"]).alias("keyframes"),
        F.array_distinct(F.flatten(ordered("faces"))).alias("faces"),
    )


def followed_by(scenes: DataFrame, order: list[str]) -> DataFrame:
    """Edges between consecutive scenes, from the end of one to the start of the next."""
    w = W.partitionBy("sid").orderBy(*order)
    nxt = scenes.select("sid", F.col("scene_id").alias("source"), F.lead("scene_id").over(w).alias("target"), F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(w).alias("end_ms"))
    return nxt.where(F.col("target").isNotNull())


def present_in(grouped: DataFrame) -> DataFrame:
    """Faces in scenes: number of keyframes and time range."""
    rows = grouped.select("sid", F.col("group").alias("scene_id"), F.explode("faces").alias("face_id"), "start_ms", "end_ms")
    return rows.groupBy("sid", "scene_id", "face_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def object_nodes(grouped: DataFrame) -> DataFrame:
    """Objects of scenes by key: how often and when."""
    rows = grouped.select("sid", F.col("group").alias("scene_id"), F.explode("keys").alias("object_key"), "start_ms", "end_ms").where("object_key <> ''")
    return rows.groupBy("sid", "scene_id", "object_key").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def occurred_in(turns: DataFrame, scenes: DataFrame, bucket_ms: int = 4000, least_ms: int = 120) -> DataFrame:
    """Turns in scenes with at least ``least_ms`` of overlap, and the share of each."""
    pairs = overlap_join(turns, scenes, ["sid"], bucket_ms).where(F.col("overlap_ms") >= least_ms)
    share = lambda a, b: r6(F.col("overlap_ms") / F.greatest(F.lit(1), F.col(b) - F.col(a)))
    return pairs.select(
        "sid", "turn_id", F.col("r_scene_id").alias("scene_id"), "overlap_start", "overlap_end", "overlap_ms",
        share("start_ms", "end_ms").alias("turn_coverage"), share("r_start_ms", "r_end_ms").alias("scene_coverage"),
    )


def discussed_in(links: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics in scenes over the turns that carry them: total overlap, range, turns in order."""
    rows = links.join(topics, ["sid", "turn_id"])
    return rows.groupBy("sid", "topic", "scene_id").agg(
        F.sum("overlap_ms").alias("overlap_ms"), F.min("overlap_start").alias("start_ms"), F.max("overlap_end").alias("end_ms"),
        F.array_sort(F.collect_set("turn_id")).alias("turns"),
    )


def interactions(rows: DataFrame) -> DataFrame:
    """Edges of equal (subject, predicate, object): count, range, descriptions in order, bases sorted."""
    return rows.groupBy("sid", "subject", "predicate", "object").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "description"))), lambda x: x["description"])).alias("descriptions"),
        F.array_sort(F.collect_set("basis")).alias("bases"),
    )


#: Event types of edge predicates; the rest goes by the type of the source node.
EVENT_TYPES = {
    "present_in": "person_seen", "contains": "object_detected", "speaking": "person_speaking", "identity_candidate": "identity_candidate",
    "expresses": "dialogue_linked", "about": "dialogue_linked", "has_intent": "dialogue_linked", "occurred_in": "dialogue_linked", "discussed_in": "dialogue_linked",
    "followed_by": "relation_observed",
}
PEOPLE = ("person", "visual_identity")


def graph_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ordered event stream of a graph.

    ``nodes``: sid, n, id, type, start_ms; ``edges``: sid, n, id, source,
    target, predicate, start_ms. Scenes come first at equal times, then edges,
    then nodes without edges that are no scenes. Returns sid, t, kind, type,
    subject, object (null for nodes), ref (the edge or node) and sequence.
    """
    none = F.lit(None).cast("string")
    linked = edges.select("sid", F.col("source").alias("id")).unionByName(edges.select("sid", F.col("target").alias("id"))).distinct()
    of_node = lambda df, kind, name: df.select(
        "sid", F.col("start_ms").alias("t"), F.lit(kind).alias("kind"), "n", F.lit(name).alias("type"), F.col("id").alias("subject"), none.alias("object"), F.col("id").alias("ref")
    )
    scenes = of_node(nodes.where("type = 'scene'"), 0, "scene_changed")
    alone = of_node(nodes.where("type <> 'scene'").join(linked, ["sid", "id"], "left_anti"), 2, "node_available")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("predicate"))
    people = nodes.where(F.col("type").isin(*PEOPLE)).select("sid", F.col("id").alias("source"), F.lit(True).alias("person")).distinct()
    kinds = edges.join(people, ["sid", "source"], "left").select(
        "sid", F.col("start_ms").alias("t"), F.lit(1).alias("kind"), "n",
        F.coalesce(named, F.when(F.col("person"), F.lit("interaction_detected")).otherwise(F.lit("relation_observed"))).alias("type"),
        F.col("source").alias("subject"), F.col("target").alias("object"), F.col("id").alias("ref"),
    )
    w = W.partitionBy("sid").orderBy("t", "kind", "n")
    return scenes.unionByName(kinds).unionByName(alone).withColumn("sequence", F.row_number().over(w)).drop("n")


def snapshot(events: DataFrame, at_ms: Column | int, window: int = 100) -> DataFrame:
    """The last ``window`` events of each session by a time, and how many there were."""
    at = at_ms if isinstance(at_ms, Column) else F.lit(at_ms)
    past = events.where(F.col("t") <= at)
    w = W.partitionBy("sid")
    return past.withColumn("n_past", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("sequence")))).where(F.col("k") <= window).drop("k")


def revealed(events: DataFrame, at_ms: Column | int) -> DataFrame:
    """Nodes and edges that the events up to a time have shown: sid, what (node or edge), id."""
    at = at_ms if isinstance(at_ms, Column) else F.lit(at_ms)
    shown = F.array(
        F.struct(F.lit("node").alias("what"), F.col("subject").alias("id")), F.struct(F.lit("node").alias("what"), F.col("object").alias("id")),
        F.struct(F.lit("edge").alias("what"), F.when(F.col("kind") == 1, F.col("ref")).alias("id")),
    )
    past = events.where(F.col("t") <= at).select("sid", F.explode(shown).alias("x"))
    return past.select("sid", "x.what", "x.id").where("id IS NOT NULL").distinct()


def current_scene(scenes: DataFrame, at_ms: int) -> DataFrame:
    """The last scene of each session that holds the time (at the very end, the one that ends there)."""
    last = F.max("end_ms").over(W.partitionBy("sid"))
    holds = (F.col("start_ms") <= at_ms) & ((F.col("end_ms") > at_ms) | ((F.col("end_ms") == at_ms) & (last == at_ms)))
    held = scenes.withColumn("__h", holds).where("__h")
    return held.groupBy("sid").agg(F.max_by("scene_id", F.struct("start_ms", "scene_id")).alias("scene_id"))
