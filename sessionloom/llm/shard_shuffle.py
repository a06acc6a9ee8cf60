"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in a task's memory, by a
seeded hash of id and text. Records that are alike in both hash alike; where
there are many of them, their place in the input spreads them. Pass two puts
each bucket in a canonical order, Fisher-Yates shuffles it with a generator
seeded by (seed, bucket) and hands it out. The buckets laid end to end are one
random permutation of the table; shard s is its slice [ceil(s*N/S),
ceil((s+1)*N/S)), so shard sizes are at most one row apart and every bucket
knows its global offset from the bucket counts alone. A retried task sorts
before it shuffles, so it deals the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import fresh_name, require
from .scratch import materialize


def scatter(df: DataFrame, key: str, text: str, seed: int, buckets: int, copies: int, name: str) -> DataFrame:
    """``df`` with its bucket as column ``name``.

    Records of the same key and text go to one bucket, unless there are more
    than ``copies`` of them (counted): then each goes by its place in the input,
    and the table is written, so that every reader sees the same places.
    """
    same = F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    bucket = lambda h: F.pmod(h, F.lit(buckets).cast("long"))
    many = df.select(same.alias("same")).groupBy("same").count().where(F.col("count") > copies).select("same")
    many = materialize(many, "many-copies")
    n = many.count()
    if not n:
        return df.withColumn(name, bucket(same))
    many = many.withColumnRenamed("same", fresh_name(df, name, "same"))
    marked = df.join(F.broadcast(many) if n <= 500_000 else many, same == F.col(many.columns[0]), "left")
    spread = F.when(F.col(many.columns[0]).isNull(), same).otherwise(F.xxhash64(same, F.monotonically_increasing_id()))
    return materialize(marked.withColumn(name, bucket(spread)).drop(many.columns[0]), "scattered")


def external_shuffle(
    df: DataFrame,
    key: str = "doc_id",
    shards: int = 24,
    seed: int = 17,
    bucket_bytes: int = 24 << 20,
    text: str = "text",
    copies: int = 10_000,
) -> DataFrame:
    """Deal every record of ``df`` to a shard and a slot in it, in random order.

    Returns the columns of ``df`` with ``shard`` int (0 to ``shards`` - 1) and
    ``slot`` long (gapless from 0 in each shard); columns of the input by those
    names are replaced. Shard sizes are at most one row apart. Rows with a null
    key take part and are spread by their text. The deal is the same however the
    input is partitioned, but for tables with more than ``copies`` records of
    the same key and text. Repeated rows are dealt each to a slot of its
    own. With fewer rows than shards, some shards stay empty; an empty table
    gives an empty one. The number of buckets follows the bytes of ``text``,
    so that a bucket holds about ``bucket_bytes``; a single longer text makes
    its bucket longer by itself.
    """
    require(df, key, text)
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    total, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64), F.lit(0))).first()
    buckets = max(1, -(-int(size) // bucket_bytes))
    name = fresh_name(df, "bucket")
    scattered = scatter(df, key, text, seed, buckets, copies, name)
    # One row for each bucket: its size follows the number of buckets, not the rows.
    counts = scattered.groupBy(name).count()
    sizes = np.zeros(buckets, dtype=np.int64)
    for row in counts.toLocalIterator():
        sizes[row[name]] = row["count"]
    starts = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    order = [(key, "ascending"), *[(f.name, "ascending") for f in df.schema.fields if f.name != key and isinstance(f.dataType, T.AtomicType)]]

    def deal(group: tuple, table: pa.Table) -> pa.Table:
        bucket = group[0].as_py()
        rows = table.drop_columns([name])
        n = rows.num_rows
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        rng = np.random.Generator(np.random.PCG64([seed, bucket]))
        dealt = np.arange(n)
        rng.shuffle(dealt)  # Fisher-Yates
        position = np.empty(n, dtype=np.int64)
        position[dealt] = np.arange(n) + starts.value[bucket]
        shard = (position * shards) // total
        slot = position - (shard * total + shards - 1) // shards
        rows = rows.append_column("shard", pa.array(shard.astype(np.int32)))
        rows = rows.append_column("slot", pa.array(slot))
        return rows.take(pa.array(dealt))

    return scattered.groupBy(name).applyInArrow(deal, schema)


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    dealt.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
