"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from .queries_chat import OP4_SQL, op4_chat_format
from .queries_leaks import OP3_SQL, op3_decontaminate
from .queries_lines import OP1_SQL, op1_line_dedup
from .queries_near import OP2_SQL, op2_ngram_join
from .queries_pages import op9_html_extract
from .queries_secrets import op10_secret_scan
from .queries_shards import op8_sharding
from .queries_tokens import op7_byte_bpe
from .queries_toxicity import op6_toxicity
from .queries_vectors import op5_nearest

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat_format": op4_chat_format,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_sharding": op8_sharding,
    "op9_html_extract": op9_html_extract,
    "op10_secret_scan": op10_secret_scan,
}
SQL = {"op1_line_dedup": OP1_SQL, "op2_ngram_join": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_chat_format": OP4_SQL}
