"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space and the letters that the contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for a row, also where ``body`` uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` equals that on pure ASCII, where it has a fast path; only other
    strings pay for ``translate``.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh_name(df: DataFrame, *wanted: str) -> str:
    """A column name that ``df`` lacks in any letter case."""
    taken, name = {c.lower() for c in df.columns}, "_".join(("", *wanted))
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_array(text: Column) -> Column:
    """Words of a text (A-Z lower-cased), an empty array if it has none."""
    return let(
        F.btrim(fold_ascii(text), F.lit(ASCII_SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN, -1)),
    )


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of the runs of ``width`` words, in order; empty for fewer words."""
    return let(
        words,
        lambda w: F.when(
            F.size(w) >= width,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
