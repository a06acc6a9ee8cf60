"""Session documents and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}

SPAN = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("start_s", T.DoubleType()),
    T.StructField("start", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("end", T.DoubleType()),
    T.StructField("text", T.StringType()), T.StructField("status", T.StringType()), T.StructField("attribution", T.StringType()),
])
TIMELINE = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("speech_spans", T.ArrayType(SPAN)), T.StructField("utterances", T.ArrayType(SPAN)),
    T.StructField("segments", T.ArrayType(SPAN)),
])


def checkpointed(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder of ``spark.checkpoint.dir`` and read back.

    Only a local master may go without that setting: it gets a folder of our
    own, deleted at its end.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            folder = tempfile.mkdtemp(prefix="sessionloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _OWN[app] = "file://" + folder
        root = _OWN[app]
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Raw spans of speech timelines: the first of speech_spans, utterances and segments that is there.

    One JSON document for each session. Times become milliseconds, half to even.
    """
    docs = spark.read.schema(TIMELINE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _raw_spans(docs)


def _raw_spans(docs: DataFrame) -> DataFrame:
    spans = docs.select(F.col("session_id").alias("sid"), F.posexplode(F.coalesce("speech_spans", "utterances", "segments")).alias("n", "s"))
    ms = lambda a, b: F.rint(F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}")) * 1000).cast("bigint")
    return spans.select(
        "sid", "n", F.coalesce("s.id", F.format_string("speech-interval-%06d", F.col("n") + 1)).alias("span_id"), F.col("s.speaker").alias("speaker"),
        ms("start_s", "start").alias("start_ms"), ms("end_s", "end").alias("end_ms"), F.col("s.text").alias("text"),
        F.coalesce("s.status", F.lit("final")).alias("status"), F.coalesce("s.attribution", F.lit("single_speaker")).alias("attribution"),
    )


def read_timeline_leniently(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``read_timeline`` that never raises for its files: a missing path has no spans, a broken document none of its own.

    Returns the spans and warnings. The broken documents are counted in one pass.
    """
    empty = spark.createDataFrame([], TIMELINE)
    at, fs = _files(spark, path)
    if not fs.globStatus(at(path)):
        return _raw_spans(empty), [f"no speech timeline at {path}"]
    marked = T.StructType([*TIMELINE.fields, T.StructField("_broken", T.StringType())])
    docs = spark.read.schema(marked).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    n = docs.select(F.count("_broken"), F.count_if(F.coalesce("speech_spans", "utterances", "segments").isNull() & F.col("_broken").isNull())).first()
    told = [f"{k} speech timelines {what}" for k, what in zip(n, ("can't be read", "have no spans")) if k]
    return _raw_spans(docs.where("_broken IS NULL").drop("_broken")), told


def speech_spans(raw: DataFrame, duration_ms: int | Column, offset_ms: int = 0, strict: bool = True) -> DataFrame:
    """Spans that can bind: final, of one canonical speaker, shifted and clipped to the session.

    ``duration_ms`` is a number, or a column of ``raw``.
    ``strict`` raises on a speaker that is not A to D; else such spans are left out.
    """
    known = raw.where(F.col("speaker").isNotNull() & (F.col("speaker") != "unresolved"))
    canonical = F.col("speaker").isin("A", "B", "C", "D")
    if strict:
        speaker = F.when(canonical, F.col("speaker")).otherwise(F.raise_error(F.concat(F.lit("not a canonical speaker: "), "speaker")).cast("string"))
        known = known.withColumn("speaker", speaker)
    else:
        known = known.where(canonical)
    limit = duration_ms if isinstance(duration_ms, Column) else F.lit(duration_ms)
    inside = lambda c: F.greatest(F.lit(0), F.least(limit, F.col(c) + offset_ms)).cast("bigint")
    return (
        known.where("status = 'final' AND attribution = 'single_speaker'")
        .withColumns({"start_ms": inside("start_ms"), "end_ms": inside("end_ms")})
        .where("end_ms > start_ms")
    )


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Versioned session documents, refused if they don't fit the schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of input files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: The file that names the current version of a versioned document.
CURRENT = "CURRENT"


def write_atomically(df: DataFrame, path: str, keep: int = 1) -> str:
    """Write JSON as a new version under ``path`` and let the pointer file name it.

    The pointer is one small file that is created by a single rename onto a
    name with the next number, so that readers see the old version or the new
    one, whole, at any time; a writer that dies leaves the old one. ``keep``
    versions before the new one stay for readers that have begun.
    """
    spark = df.sparkSession
    at, fs = _files(spark, path)
    numbers = _pointers(spark, path)
    n = max(numbers, default=0) + 1
    version = f"v{n:09d}-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{version}")
    fresh = f"{path}/.{CURRENT}-{uuid.uuid4().hex}"
    out = fs.create(at(fresh), False)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(at(fresh), at(f"{path}/{CURRENT}-{n:09d}")):
        fs.delete(at(fresh), False)
        fs.delete(at(f"{path}/{version}"), True)
        raise OSError(f"another writer was first at version {n} of {path}")
    for old in sorted(numbers)[: len(numbers) - keep]:
        name = _named(spark, path, old)
        fs.delete(at(f"{path}/{CURRENT}-{old:09d}"), False)
        if name:
            fs.delete(at(f"{path}/{name}"), True)
    return version


def _pointers(spark: SparkSession, path: str) -> list[int]:
    at, fs = _files(spark, path)
    found = fs.globStatus(at(f"{path}/{CURRENT}-*")) or []
    return [int(x.getPath().getName().rpartition("-")[2]) for x in found]


def _named(spark: SparkSession, path: str, n: int) -> str:
    at, fs = _files(spark, path)
    stream = fs.open(at(f"{path}/{CURRENT}-{n:09d}"))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version of a document written by ``write_atomically``."""
    numbers = _pointers(spark, path)
    if not numbers:
        raise FileNotFoundError(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{path}/{_named(spark, path, max(numbers))}")


def append_log(stream: DataFrame, path: str, checkpoint: str, sid: str = "sid"):
    """A streaming query that appends events to a JSON-lines log, a folder for each session."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy(sid).outputMode("append").trigger(availableNow=True).start()


def snapshot_log(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query whose complete result is the current version of a document after each batch."""

    def put(batch: DataFrame, _: int) -> None:
        write_atomically(batch, path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
