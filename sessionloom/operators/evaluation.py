"""Scores of predictions against sparse annotations; constraints on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..functions.text import evaluation_label, relation_key, strip

#: Environment categories, and the predicates of each kind of relation.
ENVIRONMENT_CATEGORIES = (
    "indoor_meeting", "indoor_office", "indoor_studio", "indoor_home", "indoor_public", "outdoor_public", "outdoor_nature", "stage", "vehicle", "graphic_or_title",
    "other", "unknown",
)
PREDICATES = {
    "interactions": ("speaking", "listening", "presenting", "showing", "holding", "using", "pointing_to", "sitting_with", "standing_with", "touching", "other"),
    "spatial_relations": ("co_visible_with", "left_of", "above", "visually_close_to", "overlaps_in_image"),
}


def set_metrics(df: DataFrame, expected: str, predicted: str, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of array columns; a null expectation isn't scored, an empty one is."""
    e, p = F.array_distinct(expected), F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>")))
    rows = df.where(F.col(expected).isNotNull())
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.size(F.array_intersect(e, p))).alias("tp"), F.sum(F.size(F.array_except(p, e))).alias("fp"),
        F.sum(F.size(F.array_except(e, p))).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(tp + fn == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return sums.select(*by, "frames", "tp", "fp", "fn", r6(precision).alias("precision"), r6(recall).alias("recall"), r6(f1).alias("f1"))


def accuracy(df: DataFrame, expected: str, predicted: str, by: list[str]) -> DataFrame:
    rows = df.where(F.col(expected).isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(expected).eqNullSafe(F.col(predicted))).alias("right"))


def macro(dimensions: list[Column]) -> Column:
    """Mean over the dimensions that are scored; null if none is."""
    kept = F.filter(F.array(*dimensions), lambda x: x.isNotNull())
    total = reduce(lambda a, b: a + b, [F.coalesce(d, F.lit(0.0)) for d in dimensions])
    return F.when(F.size(kept) > 0, r6(total / F.size(kept)))


def _violation(df: DataFrame, rule: str, entity: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"))


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by key in a fixed number of partitions, which adaptive execution doesn't join to tasks of many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def not_unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys of more than one row.

    Most keys are held once, so combining before the shuffle would fill a task's
    memory for nothing; a frequent key is one group and takes no more memory
    than another, but its rows (keys alone) pass through one task.
    """
    return _violation(_dealt(df.select(*keys), keys).groupBy(*keys).count().where("count > 1"), rule, F.concat_ws("/", *keys))


def dangling(df: DataFrame, parent: DataFrame, keys: list[str], entity: str, rule: str) -> DataFrame:
    """Rows without a parent. The rows of one parent are sorted in one task."""
    rows = _dealt(df.select(*dict.fromkeys([*keys, entity])), keys)
    known = _dealt(parent.select(*keys), keys).distinct().hint("merge")
    return _violation(rows.join(known, keys, "left_anti"), rule, F.col(entity))


def out_of_range(df: DataFrame, bad: Column, entity: str, rule: str) -> DataFrame:
    return _violation(df.where(bad), rule, F.col(entity))


def overlapping(df: DataFrame, keys: list[str], entity: str, rule: str) -> DataFrame:
    """Rows that begin before an earlier row of their key has ended."""
    w = W.partitionBy(*keys).orderBy("start_ms", "end_ms", entity).rowsBetween(W.unboundedPreceding, -1)
    return _violation(df.withColumn("__m", F.max("end_ms").over(w)).where(F.col("start_ms") < F.col("__m")), rule, F.col(entity))


def not_tiling(df: DataFrame, keys: list[str], entity: str, rule: str) -> DataFrame:
    """Rows that don't begin where the one before ends."""
    w = W.partitionBy(*keys).orderBy("start_ms", entity)
    return _violation(df.withColumn("__e", F.lag("end_ms").over(w)).where(F.col("start_ms") != F.col("__e")), rule, F.col(entity))


def mismatched(claimed: DataFrame, counted: DataFrame, keys: list[str], claim: str, count: str, rule: str) -> DataFrame:
    """Keys whose claimed value is not the recomputed one, those that only one side has included."""
    both = claimed.join(counted, keys, "full_outer")
    return _violation(both.where(~F.col(claim).eqNullSafe(F.col(count))), rule, F.concat_ws("/", *keys))


def shared_bucket(df: DataFrame, keys: list[str], time: str, entity: str, rule: str, step_ms: int = 40) -> DataFrame:
    """Time buckets (half to even) in which more than one ``entity`` of a key is active."""
    bucket = F.rint(F.col(time) / step_ms).cast("bigint").alias("bucket")
    found = df.groupBy(*keys, bucket).agg(F.min(entity).alias("a"), F.max(entity).alias("b")).where("a <> b")
    return _violation(found, rule, F.concat_ws("/", *keys, "bucket"))


def annotation_violations(
    frames: DataFrame, relations: DataFrame, keys: list[str], vocabulary: list[str] | None = None,
    categories: tuple[str, ...] = ENVIRONMENT_CATEGORIES, predicates: dict[str, tuple[str, ...]] = PREDICATES,
) -> DataFrame:
    """Faults of hand-made annotations: rule and entity (keys, joined by ``/``).

    ``frames``: keys, keyframe_id, timestamp_ms, environment_category and
    object_labels (null: not annotated). ``relations``: keys, keyframe_id, field
    (a key of ``predicates``), subject, predicate, object. A frame's labels
    break one rule at most: blank, else named twice, else outside ``vocabulary``.
    """
    id_ = F.concat_ws("/", *keys, "keyframe_id")
    labels = F.transform("object_labels", evaluation_label)
    blank = F.exists("object_labels", lambda x: F.coalesce(strip(x) == "", F.lit(True)))
    known = F.transform(F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>"), evaluation_label)
    fault = F.when(blank, F.lit("blank_label")).when(F.size(F.array_distinct(labels)) < F.size(labels), F.lit("label_twice"))
    if vocabulary is not None:
        fault = fault.when(F.size(F.array_except(labels, known)) > 0, F.lit("outside_vocabulary"))
    named = frames.where("object_labels IS NOT NULL").select(fault.alias("rule"), id_.alias("entity")).where("rule IS NOT NULL")
    bare = frames.where("environment_category IS NULL AND object_labels IS NULL").withColumn("__e", id_)
    allowed = F.lit(False)
    for field, names in predicates.items():
        allowed = allowed | ((F.col("field") == field) & F.col("predicate").isin(*names))
    keyed = relations.withColumn("__k", relation_key(F.col("subject"), F.col("predicate"), F.col("object"))).withColumn("__e", id_)
    twice = keyed.groupBy(*keys, "keyframe_id", "field", "__k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wrong_id = ~F.coalesce(F.col("keyframe_id").rlike(r"\Akeyframe-[0-9]{5}\z"), F.lit(False))
    return violations(
        _violation(frames.where(wrong_id), "keyframe_id", id_),
        not_unique(frames, [*keys, "keyframe_id"], "keyframe_twice"),
        _violation(frames.where(F.coalesce(F.col("timestamp_ms") < 0, F.lit(True))), "timestamp", id_),
        dangling(bare, relations, [*keys, "keyframe_id"], "__e", "no_dimension"),
        _violation(frames.where(~F.col("environment_category").isin(*categories)), "category", id_),
        named,
        _violation(keyed.where(F.coalesce(F.col("subject") == "", F.lit(True))), "no_subject", F.col("__e")),
        _violation(keyed.where(~F.coalesce(allowed, F.lit(False))), "predicate", F.col("__e")),
        _violation(twice, "relation_twice", id_),
    )


def lineage_violations(claimed: DataFrame, found: DataFrame) -> DataFrame:
    """Documents whose recorded digest of another isn't that file's: ``claimed`` (document, path, sha256), ``found`` (path, sha256)."""
    seen = found.select("path", F.col("sha256").alias("__s"))
    both = claimed.join(seen, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("__s")))
    return _violation(both, "lineage", F.concat_ws("/", "document", "path"))


def violations(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), found)
