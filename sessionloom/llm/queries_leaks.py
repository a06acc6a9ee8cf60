"""Query and SQL of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, benchmark)


_SHINGLES = r"""
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i
        FROM (SELECT {id} AS id,
                     list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
              FROM {table}) WHERE len(w) >= 5)
"""
OP3_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) * 10 >= 8 * any_value(n.n_item)
"""
