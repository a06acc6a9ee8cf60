"""The driver's tables as session data. Each view has its SQL twin in ``WITH`` form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("unix_micros(cast(ts AS timestamp)) div 1000")
    return table(spark, sf_dir, "events").select(
        F.expr("user_id % 8 + 8 * (user_id div 160)").alias("sid"), "event_id", "user_id", "event_type", start.alias("start_ms"),
        (start + (F.col("value") * 60000).cast("bigint")).alias("end_ms"), F.rint(F.col("value") * 100).cast("bigint").alias("score_u"),
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed_events(spark, sf_dir).where("event_type IN ('purchase', 'signup', 'error') AND end_ms > start_ms")
    speaker = F.expr("substring('ABCD', cast((user_id div 8) % 4 + 1 AS int), 1)")
    return e.select("sid", F.col("event_id").alias("span_id"), speaker.alias("speaker"), "start_ms", "end_ms")


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed_events(spark, sf_dir).where("event_type IN ('click', 'view') AND end_ms > start_ms")
    face = F.concat(F.lit("Face-0"), F.expr("1 + (user_id div 8 + user_id % 3) % 4").cast("string"))
    return e.select("sid", F.col("event_id").alias("segment_id"), face.alias("face_id"), "start_ms", "end_ms", "score_u")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).where("event_type = 'error'").select("sid", F.col("start_ms").alias("cut_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns on a line of 10 ms a character."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.char_length("text") * 10).over(w)
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(
        F.col("conv_id").alias("sid"), F.col("turn").alias("turn_id"), F.col("role").alias("speaker"),
        (end - F.char_length("text") * 10).alias("start_ms"), end.alias("end_ms"), "text",
    )


def scenes(spark: SparkSession, sf_dir: str, span_ms: int = 4000) -> DataFrame:
    """Scenes of four seconds over each dialogue."""
    spans = turns(spark, sf_dir).groupBy("sid").agg(F.max("end_ms").alias("last"))
    return spans.where("last > 0").select("sid", F.explode(F.expr(f"sequence(0, (last - 1) div {span_ms})")).alias("scene_id"), "last").select(
        "sid", "scene_id", (F.col("scene_id") * span_ms).alias("start_ms"), F.least("last", (F.col("scene_id") + 1) * span_ms).alias("end_ms")
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person states of keyframes: normalised boxes."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("p")
    )
    return one.select(
        F.col("l_orderkey").alias("keyframe_id"), F.col("l_linenumber").alias("state"), (F.col("d") * 5).alias("x"), (F.col("t") * 6).alias("y"),
        (F.col("q") / 100).alias("w"), (F.col("q") / 120).alias("h"), (0.5 + F.col("d") * 5).alias("confidence"), F.rint(F.col("p")).cast("bigint").alias("sharpness"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframe analyses: a document is one, its source the session."""
    words = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        F.col("source").alias("sid"), F.col("doc_id").alias("keyframe_id"), F.col("lang").alias("category"), F.col("text").alias("description"),
        F.array_distinct(words).alias("objects"), F.array(F.concat(F.lit("Face-0"), (F.col("doc_id") % 4 + 1).cast("string"))).alias("faces"),
        (F.col("doc_id") * 1000).alias("start_ms"), (F.col("doc_id") * 1000 + 1000).alias("end_ms"),
    )


#: SQL of the views above.
VIEWS = {
    "timed": """timed AS (SELECT user_id % 8 + 8 * (user_id // 160) AS sid, event_id, user_id, event_type, epoch_us(ts) // 1000 AS start_ms,
  epoch_us(ts) // 1000 + trunc(value * 60000)::BIGINT AS end_ms, round_even(value * 100, 0)::BIGINT AS score_u FROM events)""",
    "speech": """speech AS (SELECT sid, event_id AS span_id, substring('ABCD', ((user_id // 8) % 4 + 1)::INT, 1) AS speaker, start_ms, end_ms FROM timed
  WHERE event_type IN ('purchase', 'signup', 'error') AND end_ms > start_ms)""",
    "active": """active AS (SELECT sid, event_id AS segment_id, 'Face-0' || (1 + (user_id // 8 + user_id % 3) % 4)::VARCHAR AS face_id, start_ms, end_ms, score_u FROM timed
  WHERE event_type IN ('click', 'view') AND end_ms > start_ms)""",
    "cuts": "cuts AS (SELECT sid, start_ms AS cut_ms FROM timed WHERE event_type = 'error')",
    "turns": """turns AS (SELECT conv_id AS sid, turn AS turn_id, role AS speaker, e - length(text) * 10 AS start_ms, e AS end_ms, text FROM (
  SELECT *, sum(length(text) * 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM conversations WHERE text IS NOT NULL))""",
    "scenes": """scenes AS (SELECT sid, k AS scene_id, k * 4000 AS start_ms, least(last, (k + 1) * 4000) AS end_ms FROM (
  SELECT sid, last, unnest(range(0, (last - 1) // 4000 + 1)) AS k FROM (SELECT sid, max(end_ms) AS last FROM turns GROUP BY sid) WHERE last > 0))""",
    "boxes": """boxes AS (SELECT l_orderkey AS keyframe_id, l_linenumber AS state, min(l_discount) * 5 AS x, min(l_tax) * 6 AS y, min(l_quantity) / 100 AS w,
  min(l_quantity) / 120 AS h, 0.5::DOUBLE + min(l_discount) * 5 AS confidence, round_even(min(l_extendedprice), 0)::BIGINT AS sharpness FROM lineitem GROUP BY ALL)""",
    "analyses": """analyses AS (SELECT source AS sid, doc_id AS keyframe_id, lang AS category, text AS description,
  list_distinct(string_split(lower(text), ' ')) AS objects, ['Face-0' || (doc_id % 4 + 1)::VARCHAR] AS faces,
  doc_id * 1000 AS start_ms, doc_id * 1000 + 1000 AS end_ms FROM documents WHERE text IS NOT NULL)""",
}
NEEDS = {"speech": ["timed"], "active": ["timed"], "cuts": ["timed"], "scenes": ["turns"]}


def sql(views: str, body: str) -> str:
    """``body`` after the named views and those they need."""
    names: list[str] = []
    for v in views.split():
        for x in [*NEEDS.get(v, []), v]:
            if x not in names:
                names.append(x)
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + "\n" + body
