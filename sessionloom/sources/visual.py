"""Visual documents and scene graphs: one JSON document for each session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import read_documents

VISUAL = (
    "session_id string, source struct<duration_ms:bigint>, processing struct<sample_fps:double>, "
    "tracklets array<struct<tracklet_id:string,face_id:string,start_ms:bigint,end_ms:bigint>>, "
    "active_speaker_segments array<struct<segment_id:string,face_id:string,start_ms:bigint,end_ms:bigint,score:double>>, "
    "speaker_face_associations array<struct<speaker_label:string,face_id:string,status:string,confidence:double>>"
)
GRAPH = (
    "session_id string, nodes array<struct<id:string,type:string,label:string,attributes:struct<start_ms:bigint,end_ms:bigint>>>, "
    "edges array<struct<id:string,source:string,target:string,predicate:string,start_ms:bigint,end_ms:bigint>>"
)
CUTS = "session_id string, shot_boundaries_ms array<bigint>"


class VisualDocuments:
    """The tables of visual documents, by session id as ``sid``."""

    def __init__(self, spark: SparkSession, path: str):
        docs = read_documents(spark, path, VISUAL)
        part = lambda name: docs.select(F.col("session_id").alias("sid"), F.inline(name))
        fps = F.coalesce("processing.sample_fps", F.lit(5.0))
        self.sessions = docs.select(
            F.col("session_id").alias("sid"), F.col("source.duration_ms").alias("duration_ms"), F.greatest(F.lit(1), F.rint(1000 / fps)).cast("bigint").alias("period_ms")
        )
        self.tracklets, self.segments = part("tracklets"), part("active_speaker_segments").where("face_id IS NOT NULL")
        self.associations = part("speaker_face_associations").withColumnRenamed("speaker_label", "speaker")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (sid, n, id, type, start_ms, end_ms) and edges (sid, n, id, source, target, predicate, start_ms, end_ms) of graphs."""
    docs = read_documents(spark, path, GRAPH)
    nodes = docs.select(F.col("session_id").alias("sid"), F.posexplode("nodes").alias("n", "x")).select(
        "sid", "n", "x.id", "x.type", F.coalesce("x.attributes.start_ms", F.lit(0)).alias("start_ms"), F.col("x.attributes.end_ms").alias("end_ms")
    )
    edges = docs.select(F.col("session_id").alias("sid"), F.posexplode("edges").alias("n", "x")).select("sid", "n", "x.*")
    return nodes, edges


def read_cuts(spark: SparkSession, path: str) -> DataFrame:
    """Shot boundaries: documents with ``session_id`` and ``shot_boundaries_ms``."""
    docs = read_documents(spark, path, CUTS)
    return docs.select(F.col("session_id").alias("sid"), F.explode("shot_boundaries_ms").alias("cut_ms"))
