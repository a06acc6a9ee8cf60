"""Query and SQL of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import Threshold, link_documents


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_documents(docs, width=3, threshold=Threshold(90, 100))


#: All links by brute force: every pair of sets that share a shingle, and the closure of the links between them.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, g AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)
), sets AS (
  SELECT doc_id, count(*) AS n, list(h ORDER BY h) AS s FROM sh GROUP BY doc_id
), classes AS (
  SELECT min(doc_id) AS c, any_value(n) AS n, s, list(doc_id) AS members FROM sets GROUP BY s
), cs AS (
  SELECT c, n, unnest(s) AS h FROM classes
), pairs AS (
  SELECT a.c AS a, b.c AS b FROM cs a JOIN cs b ON a.h = b.h AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), comp AS (SELECT a, min(b) AS comp FROM reach GROUP BY a
), found AS (SELECT unnest(members) AS doc_id, n, comp FROM classes JOIN comp ON a = c)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(comp, d.doc_id) AS component_id FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""
