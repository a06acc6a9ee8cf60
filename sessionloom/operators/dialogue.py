"""Topics, opinions and intents of a dialogue, as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

#: Fixed value: the topic of turns without one.
NO_TOPIC = "未归类话题"


def ordinal(df: DataFrame, keys: list[str], order: list, prefix: str, digits: int = 4) -> DataFrame:
    """``df`` with ``id``: the prefix and the row's place within its keys."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("id", F.format_string(f"{prefix}%0{digits}d", n))


def turn_topics(turns: DataFrame, scene_topics: DataFrame) -> DataFrame:
    """Topics of each turn: its own, else those it is evidence for, else ``NO_TOPIC``.

    ``turns``: sid, turn_id, topics (array); ``scene_topics``: sid, n, name,
    turn_ids. Returns sid, turn_id, name, pos.
    """
    clean = F.filter(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda x: strip(x)), lambda x: x != "")
    named = scene_topics.where(strip(F.col("name")) != "").select("sid", "n", strip(F.col("name")).alias("name"), F.explode("turn_ids").alias("turn_id"))
    from_scene = named.groupBy("sid", "turn_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("theirs"))
    rows = turns.withColumn("own", clean).join(from_scene, ["sid", "turn_id"], "left")
    names = F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("theirs", F.array(F.lit(NO_TOPIC))))
    return rows.select("sid", "turn_id", F.posexplode(F.array_distinct(names)).alias("pos", "name"))


def topic_catalog(turns: DataFrame, scene_topics: DataFrame) -> DataFrame:
    """All topics in order of first mention, those of the scene first, with the turns that are their evidence.

    Returns sid, id, name, turn_ids (in order of mention, each once).
    """
    named = scene_topics.where(strip(F.col("name")) != "").select("sid", strip(F.col("name")).alias("name"), "n", F.posexplode_outer("turn_ids").alias("pos", "turn_id"))
    by_scene = named.select("sid", "name", F.struct(F.lit(0).alias("phase"), F.col("n").cast("bigint").alias("n"), F.coalesce("pos", F.lit(0)).alias("pos")).alias("at"), "turn_id")
    by_turn = turn_topics(turns, scene_topics).select("sid", "name", F.struct(F.lit(1).alias("phase"), F.col("turn_id").cast("bigint").alias("n"), "pos").alias("at"), "turn_id")
    found = by_scene.unionByName(by_turn).groupBy("sid", "name").agg(
        F.min("at").alias("first"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn_id").isNotNull(), F.struct("at", "turn_id")))), lambda x: x["turn_id"])).alias("turn_ids"),
    )
    return ordinal(found, ["sid"], ["first"], "topic:").select("sid", "id", "name", "turn_ids")


def intents(turns: DataFrame) -> DataFrame:
    """Intents in order of first mention: their time, turns, and speakers in order. ``turns``: sid, turn_id, speaker, intent, start_ms, end_ms."""
    rows = turns.withColumn("name", strip(F.col("intent"))).where("name <> ''")
    in_order = F.array_sort(F.collect_list(F.struct("turn_id", "speaker")))
    found = rows.groupBy("sid", "name").agg(F.min("turn_id").alias("first"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), in_order.alias("seen"))
    placed = ordinal(found, ["sid"], ["first"], "intent:")
    return placed.select(
        "sid", "id", "name", "start_ms", "end_ms", F.transform("seen", lambda x: x["turn_id"]).alias("turn_ids"), F.array_distinct(F.transform("seen", lambda x: x["speaker"])).alias("speakers"),
    )


def dialogue_edges(turns: DataFrame, scene_topics: DataFrame) -> DataFrame:
    """Edges around the opinion of each turn: its speaker expresses it, its topics are about it, it has an intent."""
    opinion = F.concat(F.lit("opinion:"), F.col("turn_id").cast("string"))
    base = turns.select("sid", "turn_id", "speaker", "intent", "start_ms", "end_ms", opinion.alias("opinion"))
    edge = lambda df, source, predicate, target: df.select("sid", "turn_id", F.col(source).alias("source"), F.lit(predicate).alias("predicate"), F.col(target).alias("target"), "start_ms", "end_ms")
    topics = topic_catalog(turns, scene_topics).select("sid", "name", "id")
    said = edge(base.withColumn("who", F.concat(F.lit("person:speaker:"), "speaker")), "who", "expresses", "opinion")
    about = edge(base.join(turn_topics(turns, scene_topics), ["sid", "turn_id"]).join(topics, ["sid", "name"]), "id", "about", "opinion")
    meant = edge(base.withColumn("name", strip(F.col("intent"))).join(intents(turns).select("sid", "name", "id"), ["sid", "name"]), "opinion", "has_intent", "id")
    return said.unionByName(about).unionByName(meant)
