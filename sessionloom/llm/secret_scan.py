"""Secret scan: base patterns, and who owns what they match.

Candidates are matched in every whole text. Their values are hashed and
aggregated over the corpus by distinct repositories and distinct owners: a
value that many owners or many repositories hold is a copied example; one that
a single owner holds in few repositories and that looks like a live credential
is reported as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import require, text_or_empty
from .scratch import materialize

# The kinds in their listed order, their patterns, the group that holds the value, its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    least: int


KINDS = (Kind("assign", ASSIGN, 2, 6), Kind("access", ACCESS, 0, 20), Kind("hex", HEX, 0, 24))
#: What the ownership adds, ranked after the base kinds at equal starts.
CLASSES = ("live", "example")


def matches(text: Column, kind: Kind) -> Column:
    """Array of (start, end, value start, value) of the matches, in code points.

    The gaps between matches come from ``split``, the matches from
    ``regexp_extract_all``; summing both gives the places. The value ends where
    the match ends.
    """
    gaps = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = whole if kind.group == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    trio = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")
    )
    span = "struct<start:int,end:int,from:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["whole"])
        found = F.struct(
            begin.alias("start"), end.alias("end"), (end - F.char_length(x["value"])).alias("from"), x["value"].alias("value")
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    found = F.aggregate(trio, start, step, lambda acc: acc["out"])
    long_enough = F.filter(found, lambda s: F.char_length(s["value"]) >= kind.least)
    return F.when(text.rlike(kind.pattern), long_enough).otherwise(F.array().cast(f"array<{span}>"))


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` and ``found``, its base spans in order."""
    text = text_or_empty("text")
    def tagged(rank: int, kind: Kind) -> Column:
        return F.transform(
            matches(text, kind),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                F.lit(kind.name).alias("kind"), s["from"].alias("from"), s["value"].alias("value"),
            ),
        )

    return docs.select(*keep, F.array_sort(F.concat(*[tagged(rank, k) for rank, k in enumerate(KINDS)])).alias("found"))


def ownership(values: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate hash.

    ``values`` has h1, h2, repo and owner. A row for each (hash, repo, owner) is
    made first, so a value that a third of the corpus holds is combined before
    the shuffle and in its tasks.
    """
    once = values.groupBy("h1", "h2", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("h1", "h2").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def scan_secrets(
    docs: DataFrame,
    repo: str | Column = "doc_id",
    owner: str | Column = "source",
    example_owners: int = 3,
    live_chars: int = 16,
    example_repos: int = 10,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Base spans of every whole text, and spans of values classed by ownership.

    Returns doc_id, ``found`` (array of start, rank, end, kind, from, value:
    the base spans by start, then kind as listed) and ``classed`` (array of
    start, rank, end, kind with kind ``example`` for values that at least
    ``example_owners`` distinct owners hold or that are in at least
    ``example_repos`` distinct repositories, of one owner or more, and ``live``
    for other values of a single owner with at least ``live_chars`` code points
    among which are a digit and a letter). A span of ``classed`` covers the
    value alone. Offsets are code points, the end exclusive.

    A null text has no spans. A null repository or owner counts as one of its
    own. Rows that repeat a doc_id each come back with their own spans. An
    empty table gives an empty one; further columns are ignored.
    """
    require(docs, "doc_id", "text")
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    named = docs.select(
        "doc_id", "text",
        F.coalesce(as_column(repo).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(as_column(owner).cast("string"), F.lit("")).alias("owner"),
    )
    base = materialize(candidates(named, ["doc_id", "repo", "owner"]).withColumn("row", F.monotonically_increasing_id()), "secrets")
    value = F.col("s.value")
    spans = base.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("s"))
    hashed = spans.select("*", F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(7), value).alias("h2"))
    owners = ownership(hashed.select("h1", "h2", "repo", "owner"))
    looks_live = (F.char_length(value) >= live_chars) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    kind = F.when(copied, "example").when((F.col("n_owners") == 1) & F.col("live"), "live")
    # One row for each classed value, written first: a join with a written table is broadcast or split at hot values.
    named_kinds = hashed.select("h1", "h2", looks_live.alias("live")).distinct().join(owners, ["h1", "h2"])
    kinds = materialize(named_kinds.select("h1", "h2", kind.alias("kind")).where(F.col("kind").isNotNull()), "secret-kinds")
    kinds = F.broadcast(kinds) if kinds.count() <= broadcast_rows else kinds
    classed = (
        hashed.join(kinds, ["h1", "h2"])
        .select(
            "row",
            F.struct(
                F.col("s.from").alias("start"), F.when(F.col("kind") == "live", 3).otherwise(4).alias("rank"),
                F.col("s.end").alias("end"), "kind",
            ).alias("c"),
        )
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("c")).alias("classed"))
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return base.join(classed, "row", "left").select("doc_id", "found", F.coalesce("classed", none).alias("classed"))


def spell(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
