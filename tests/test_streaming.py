"""Streaming forms against the batch operators."""

from pyspark.sql import functions as F

from sessionloom.operators import activity
from sessionloom.streaming.speaking import context_windows, newest_tasks, speaking_stream


def run(stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_phases_of_a_stream_equal_the_batch_ones(spark, tmp_path):
    base = 3_600_000  # the watermark begins at 0: nothing may be as old
    on = {"01": [*range(0, 1000, 40), *range(4000, 4400, 40)], "02": [*range(1000, 2000, 40), 5000]}
    rows = [(1, f, base + t, t in ts) for f, ts in on.items() for t in range(0, 6000, 40)]
    df = spark.createDataFrame(rows, "sid long, face_id string, t long, speaking boolean").withColumn("ts", F.timestamp_millis("t"))
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run(speaking_stream(stream), "append", "phases")
    got = sorted((r.face_id, r.t, r.phase) for r in spark.table("phases").where("phase <> 'continued'").collect())
    want = []
    for r in activity.speaking_phases(df, ["sid", "face_id"], base + 5960).collect():
        want.append((r.face_id, r.started_ms, "started"))
        if r.ended_ms is not None:
            want.append((r.face_id, r.ended_ms, "ended"))
    assert got == sorted(want) and len(got) == 6


def test_windows_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 3_600_000 + t) for t in range(0, 10_000, 250)], "sid long, t long").withColumn("ts", F.timestamp_millis("t"))
    df.write.parquet(f"{tmp_path}/in")
    run(context_windows(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), "append", "windows")
    full = spark.table("windows").where("window_start >= timestamp_millis(3600000) AND window_end <= timestamp_millis(3609000)").collect()
    assert full and all((r.n_context, r.n_published) == (16, 4) for r in full)


def test_oldest_tasks_are_dropped(spark):
    kept, dropped = newest_tasks(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "sid long, seq long"), ["sid"], "seq", 2)
    assert sorted(r.seq for r in kept.collect()) == [2, 3] and [r.seq for r in dropped.collect()] == [1]
