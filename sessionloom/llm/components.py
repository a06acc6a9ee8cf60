"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node it reaches) of the nodes in ``edges`` (a, b).

    A round takes each node's smallest neighbouring label and then the label's
    own label, so that a path halves; stars take two rounds. Rounds go on until
    no label changes; each is written to the shared folder. Minima are combined
    before they are shuffled, so a node with any number of edges is one row of
    each task.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
    )
    both = materialize(both.where(F.col("node") != F.col("to")).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("to"), F.col("comp").alias("theirs")), "to")
            .groupBy("node")
            .agg(F.min("theirs").alias("theirs"))
        )
        step = labels.join(near, "node").select("node", F.least("comp", "theirs").alias("next"), F.col("comp").alias("was"))
        jumped = (
            step.join(labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond")), "next", "left")
            .select("node", F.least("next", F.coalesce("beyond", "next")).alias("comp"), "was")
        )
        new = materialize(jumped, "labels")
        changed = new.where(F.col("comp") != F.col("was")).limit(1).count()
        discard(spark, labels)
        labels = new.select("node", "comp")
        if not changed:
            return labels
