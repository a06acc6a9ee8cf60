"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object labels that mean another.
ALIASES = {"mic": "microphone", "potted_plant": "plant"}
#: Predicates whose two sides may change places.
SYMMETRIC = ("co_visible_with", "visually_close_to", "overlaps_in_image", "sitting_with", "standing_with")


#: White space as a character class: what Unicode and the ASCII separators make one.
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

#: The same, one by one.
SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(s: Column) -> Column:
    """A string without white space at its ends."""
    return F.btrim(s, F.lit(SPACE_CHARS))


def joined_words(s: Column, glue: str) -> Column:
    """The words of a string with ``glue`` between them and none at the ends."""
    return F.regexp_replace(strip(s), SPACES, glue)


def letters(s: Column) -> Column:
    """Lower-case letters and numbers only."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def bigrams(s: Column) -> Column:
    """Distinct character pairs of ``letters``; a single character stands for itself."""

    def pairs(chars: Column) -> Column:
        both = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(a, b))
        return F.when(F.size(chars) >= 2, F.array_distinct(both)).otherwise(chars)

    return let(F.filter(F.split(letters(s), ""), lambda c: c != ""), pairs)


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_distinct(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays that hold each value once: one look at both."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(let(shared, lambda n: n / (F.size(a) + F.size(b) - n)))


def object_key(s: Column) -> Column:
    return joined_words(F.lower(s), "_")


def evaluation_label(s: Column) -> Column:
    return joined_words(F.lower(F.replace(s, F.lit("_"), F.lit(" "))), " ")


def canonical_label(s: Column) -> Column:
    key = joined_words(F.lower(F.replace(s, F.lit("-"), F.lit(" "))), "_")
    named = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return let(key, lambda k: F.coalesce(F.element_at(named, k), k))


def join_texts(parts: Column) -> Column:
    """Texts end to end, with a space only between ASCII letters or digits."""

    def add(acc: Column, x: Column) -> Column:
        glue = F.when(acc.rlike(r"[A-Za-z0-9]\z") & x.rlike("^[A-Za-z0-9]"), F.lit(" ")).otherwise(F.lit(""))
        return F.concat(acc, glue, x)

    return F.aggregate(parts, F.lit(""), add)


def relation_key(subject: Column, predicate: Column, target: Column) -> Column:
    """(subject, predicate, object) with the smaller name first for symmetric predicates; a null object is ''."""
    obj = F.coalesce(target, F.lit(""))
    swap = predicate.isin(*SYMMETRIC) & (obj < subject)
    return F.struct(
        F.when(swap, obj).otherwise(subject).alias("subject"), predicate.alias("predicate"),
        F.when(swap, subject).otherwise(obj).alias("object"),
    )


def content_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: the first 16 hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16))
