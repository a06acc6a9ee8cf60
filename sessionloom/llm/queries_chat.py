"""Query and SQL of the chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, read_windows

#: A conversation whose texts are control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def chat_digests(windows: DataFrame) -> DataFrame:
    read = read_windows(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), "formatted_chars", "loss_text",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    joined = lambda name: F.array_join(F.transform(F.col("parts"), lambda p: p[name]), "")
    gathered = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss_text"))).alias("parts"),
        F.sum("formatted_chars").cast("long").alias("formatted_chars"),
    )
    return gathered.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.char_length(joined("loss_text")).cast("long").alias("loss_chars"), F.sha2(joined("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{PROBE}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{PROBE}'"
    )
    return chat_digests(format_chats(rows.unionByName(probe)))


_LEN = """(length(role) + length(text) + 17
  + 4 * (length(role || text) - length(replace(role || text, '&', '')))
  + {marks})"""
_MARKS = " + ".join(
    # each replaced mark adds the length of its entity less one
    f"{add} * ((length(role || chr(1) || text) - length(replace(role || chr(1) || text, '{mark}', ''))) // {len(mark)})"
    for mark, add in (("<|", 3), ("<s>", 3), ("</s>", 3), ("<<SYS>>", 3), ("<</SYS>>", 3), ("[INST]", 4), ("[/INST]", 4))
)
OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), t AS (
  SELECT *, {_LEN.format(marks=_MARKS)} AS len, (strlen(text) + 3) // 4 + 4 AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows
), s AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM t
), p AS (SELECT *, (e - 1) // 1024 AS span, e - tokens AS begin FROM s),
spans AS (SELECT DISTINCT conv_id, span FROM p),
again AS (
  SELECT p.conv_id, p.len, p.n, x.span FROM p JOIN spans x ON x.conv_id = p.conv_id AND x.span = p.span + 1
  WHERE p.begin >= (p.span + 1) * 1024 - 256
  UNION ALL
  -- a long turn leaves the span before its window empty: the turns right before it, of at most 256 tokens together
  SELECT p.conv_id, p.len, p.n, x.span FROM p JOIN p x ON x.conv_id = p.conv_id AND p.e <= x.begin AND p.begin >= x.begin - 256
  WHERE x.tokens > 1024 AND x.begin > 0 AND (x.begin - 1) // 1024 < x.span - 1
), heads AS (
  SELECT p.conv_id, p.len, x.span FROM p JOIN spans x ON x.conv_id = p.conv_id AND x.span <> p.span
  WHERE p.n = 1 AND p.role = 'system'
    AND NOT EXISTS (SELECT 1 FROM again a WHERE a.conv_id = p.conv_id AND a.span = x.span AND a.n = 1)
), extra AS (
  SELECT conv_id, sum(len) AS len FROM (SELECT conv_id, len FROM again UNION ALL SELECT conv_id, len FROM heads) GROUP BY conv_id
), own AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
         sum(len) AS len FROM p GROUP BY conv_id
)
SELECT own.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (own.len + coalesce(extra.len, 0))::BIGINT AS formatted_chars
FROM own LEFT JOIN extra ON own.conv_id = extra.conv_id
"""
