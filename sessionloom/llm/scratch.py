"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders made since the innermost ``scratch_scope`` began.
_MADE: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master (unit tests, one machine) may go without: it gets a
    folder of our own, once per application, that is deleted at its end. A
    cluster whose session names none is an error, since its executors would
    each write to a disk that the others don't see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="sessionloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor; a retried stage
    that reads them sees the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by ``materialize`` that nothing needs any more."""
    root = shared_root(spark)
    folders = {f[: f.index("/", f.index(root.split("://")[-1]) + len(root.split("://")[-1]) + 1)] for f in df.inputFiles()}
    for folder in folders:
        _delete(spark, folder)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are made within, at the end.

    For a caller that has written its result elsewhere by then; results that
    are still to be computed read these tables.
    """
    _MADE.append([])
    try:
        yield
    finally:
        for folder in _MADE.pop():
            _delete(spark, folder)
