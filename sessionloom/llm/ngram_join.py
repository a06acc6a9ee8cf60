"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word shingles. All sets are ordered alike: shingles that
a frequency sketch of the whole corpus calls frequent come last, within that by
hash. Two sets with enough overlap share at least l shingles within their
l-prefixes; each document chooses the l, and with it the prefix length, that
its estimated candidate cost makes cheapest, and a pair is verified only if it
shares as many prefix shingles as the smaller of its two l.

Groups of copies never become pairs within themselves. Equal sets are one
class. Classes that share MinHash keys with a pivot are compared with it, and
what links to it forms stars. The join then looks only for pairs of different
components: of a shingle's documents, those outside its most frequent component
are paired with the others.

Two classes of the same pivot are compared by what differs from it. The
symmetric difference of the two sets is that of their differences, so a link
needs a known share of the differences in common; their prefixes, rarest
shingles first, take the place of the sets' own, and the distances to the pivot
rule out most pairs at once. So a large group whose members drift apart costs what its
edits have in common, not its square. Of the pairs that are left, one for each
class is verified first; those whose components it joins need no look. All links between components are
still found: a pair is linked already, or has the same pivot, or meets in a
prefix of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import fresh_name, require
from .components import connected_components
from .memory import released
from .scratch import materialize

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_RNG = np.random.default_rng(20240229)
#: Random 64-bit values of the bytes, and odd multipliers.
BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = (int(_RNG.integers(1, 2**62)) * 8 + 5) % (1 << 64)
MULTIPLIERS = _RNG.integers(1, 2**63, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEYS = 8
#: MinHash keys that a class shares with a pivot to be compared with it.
SHARED_KEYS = 3
#: Words of the bitmap of a set or of a set of differences, and their columns. All -1: no bitmap.
MAP_WORDS = 8
MAPS = [f"map{w}" for w in range(MAP_WORDS)]
CHUNK = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finalizer of 64-bit hashes; wraps around."""
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIERS[salt]
    x = (x ^ (x >> np.uint64(29))) * MULTIPLIERS[salt + 1]
    return x ^ (x >> np.uint64(32))


#: Bytes that are hashed at a time; a longer word is hashed by itself.
BLOCK = 1 << 20


def _powers(base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64."""
    steps = np.full(size, np.uint64(base))
    steps[0] = 1
    return np.multiply.accumulate(steps)


INVERSE = pow(BASE, -1, 1 << 64)
UP, DOWN = _powers(BASE, 1 << 16), _powers(INVERSE, 1 << 16)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, in blocks of about ``BLOCK`` bytes, so that a long text needs no more room than a short one."""
    global UP, DOWN
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, side="right")))
        first, size = int(starts[lo]), int(ends[hi - 1] - starts[lo])
        if len(UP) < size <= BLOCK:
            UP, DOWN = _powers(BASE, BLOCK), _powers(INVERSE, BLOCK)
        up = UP[:size] if size <= len(UP) else _powers(BASE, size)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(BYTES[flat[first : first + size]] * up, out=sums[1:])
        at = starts[lo:hi] - first
        down = DOWN[at] if hi - lo > 1 else np.ones(1, dtype=np.uint64)
        out[lo:hi] = mix((sums[ends[lo:hi] - first] - sums[at]) * down)
        lo = hi
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text.

    With fewer words than ``width``, the whole sequence is one shingle; without
    words the set is empty.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = FOLD[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    n = len(flat)
    if not n:
        return [np.empty(0, dtype=np.int64) for _ in texts]
    edge = np.concatenate([[0], np.cumsum(sizes)])
    space = SPACE[flat]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, space[:-1]
    before[edge[:-1][edge[:-1] < n]] = True
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    after[edge[1:][edge[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    words = word_hashes(flat, starts, ends)
    first = np.searchsorted(starts, edge)  # words before each text
    hashes = words[: max(0, len(words) - width + 1)].copy() if width <= len(words) else np.empty(0, dtype=np.uint64)
    for k in range(1, width):
        hashes = mix(hashes) + words[k : k + len(hashes)] * MULTIPLIERS[2 + k % 8]
    hashes = mix(hashes, 4).view(np.int64)
    out = []
    for i in range(len(texts)):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= width:
            out.append(np.unique(hashes[lo : hi - width + 1]))
        elif hi > lo:
            h = np.full(1, hi - lo, dtype=np.uint64)
            for w in range(lo, hi):
                h = mix(h) + words[w : w + 1] * MULTIPLIERS[10]
            out.append(mix(h, 6).view(np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out


def _byte_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, with the place of the first."""
    held: list[bytes] = []
    size = at = 0
    for i, x in enumerate(column.cast(pa.binary())):
        b = x.as_py() or b""
        held.append(b)
        size += len(b)
        if size >= most:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


@dataclass(frozen=True)
class Threshold:
    """Jaccard of at least ``num / den``, in integers."""

    num: int = 8
    den: int = 10

    def prefix(self, n: int) -> int:
        """Length of the 1-prefix: n less the least overlap with any partner, plus one."""
        return n - -(-self.num * n // self.den) + 1


def frequency_sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Document frequencies of all shingles, summed in 2**bits buckets: fixed in size, over every text."""
    mask = (1 << bits) - 1
    piece = 1 << min(bits, 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, texts in _byte_chunks(batch.column(0)):
                total += np.bincount(np.concatenate(shingle_sets(texts, width)) & mask, minlength=1 << bits)
        for lo in range(0, 1 << bits, piece):
            part = total[lo : lo + piece]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([part.tolist()], pa.list_(pa.int64()))], names=["lo", "part"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        parts = table["part"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return pa.table({"lo": [key[0].as_py()], "part": pa.array([parts.sum(axis=0).tolist()], pa.list_(pa.int64()))})

    schema = "lo long, part array<long>"
    partial = docs.select("text").mapInArrow(released(count), schema)
    out = np.zeros(1 << bits, dtype=np.int64)
    for row in partial.groupBy("lo").applyInArrow(add, schema).toLocalIterator():
        out[row["lo"] : row["lo"] + piece] = row["part"]
    return out


def parity_maps(flat: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Bitmaps of the sets that begin at ``heads``: a shingle flips one bit.

    Of two bitmaps, the bits that differ are at most as many as the shingles
    that only one of the sets has.
    """
    bit = (flat.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * MAP_WORDS)
    word, flips = bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(word == w, flips, np.uint64(0)), heads) for w in range(MAP_WORDS)])


def document_sets(docs: DataFrame, sketch: np.ndarray, width: int, at: Threshold, most_matches: int, frequent: int) -> DataFrame:
    """doc_id, n, s1, s2 (the set's identity), keys (MinHash), a bitmap (MAPS), matches (its l) and prefix of every document."""
    mask = len(sketch) - 1
    usual = int(sketch.mean())
    shared = docs.sparkSession.sparkContext.broadcast(np.maximum(sketch - usual, 0).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = shared.value
        ls = np.arange(1, most_matches + 1)
        for batch in batches:
            for lo, texts in _byte_chunks(batch.column(1)):
                sets = shingle_sets(texts, width)
                ids, n = batch.column(0).slice(lo, len(texts)), np.array([len(s) for s in sets], dtype=np.int32)
                flat = np.concatenate(sets)
                heads = np.concatenate([[0], np.cumsum(n)])[:-1]
                some = n > 0
                s, maps = (np.zeros((rows, len(sets)), dtype=np.uint64) for rows in (2 + KEYS, MAP_WORDS))
                if some.any():
                    for i in range(2 + KEYS):
                        s[i, some] = (np.add if i < 2 else np.minimum).reduceat(mix(flat.view(np.uint64) ^ MULTIPLIERS[8 + i], i), heads[some])
                    maps[:, some] = parity_maps(flat, heads[some])
                costs = over[flat & mask]
                prefixes, matches = [], np.ones(len(sets), dtype=np.int32)
                for i, own in enumerate(sets):
                    if not len(own):
                        prefixes.append(own)
                        continue
                    cost = costs[heads[i] : heads[i] + len(own)]
                    late = cost > frequent
                    order = np.argsort(late, kind="stable") if late.any() else slice(None)
                    p = at.prefix(len(own))
                    last = min(most_matches, len(own) - p + 1)
                    sums = np.cumsum(cost[order][: p + last - 1] + 1)[p - 1 :]
                    # Postings to read, and the candidates to verify that they can make at most.
                    choice = int(np.argmin(sums * 1.0 + sums * 8.0 / ls[: len(sums)]))
                    matches[i] = choice + 1
                    prefixes.append(own[order][: p + choice])
                lens = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                signed = s.view(np.int64)
                keys = np.ascontiguousarray(signed[2:].T).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(n), pa.array(signed[0]), pa.array(signed[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * KEYS), pa.array(keys)),
                        *map(pa.array, maps.view(np.int64)), pa.array(matches),
                        pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(prefixes))),
                    ],
                    names=["doc_id", "n", "s1", "s2", "keys", *MAPS, "matches", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        released(run),
        f"doc_id long, n int, s1 long, s2 long, keys array<long>, {', '.join(f'{m} long' for m in MAPS)}, matches int, prefix array<long>",
    )


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """uid and its whole set, for verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _byte_chunks(batch.column(1)):
                sets = shingle_sets(texts, width)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))],
                    names=["uid", "set"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(run), "uid long, set array<long>")


def compared(docs: DataFrame, pairs: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """Pairs (a, b) with their sets x, y and the number of shingles they share.

    The documents that are needed are picked by a broadcast of their ids if
    these are at most ``broadcast_rows`` (counted), else by a shuffle join.
    """
    side = lambda c: pairs.select(F.col(c).alias("doc_id")).distinct()
    ids = materialize(side("a").unionByName(side("b")).distinct(), "pair-ids")
    picked = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    sets = materialize(full_sets(docs.join(picked, "doc_id", "left_semi"), width), "pair-sets")
    left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("uid").alias("b"), F.col("set").alias("y")), "b")
    return both.withColumn("shared", F.size(F.array_intersect("x", "y")).cast("long"))


def reached(at: Threshold) -> Column:
    return at.den * F.col("shared") >= at.num * (F.size("x") + F.size("y") - F.col("shared"))


def difference_prefixes(spokes: DataFrame, sketch: np.ndarray, at: Threshold, frequent: int) -> DataFrame:
    """uid, pivot, n, dist, a bitmap (MAPS) and the prefix of what differs from the pivot.

    ``spokes``: uid, pivot, n, delta (the symmetric difference with the pivot).
    With |x| shingles, partners have at most |x| / t, so a link allows c(x)
    differences; of dist differences a partner must have dist - c(x) in common.
    """
    mask = len(sketch) - 1
    usual = int(sketch.mean())
    shared = spokes.sparkSession.sparkContext.broadcast(np.maximum(sketch - usual, 0).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = shared.value
        for batch in batches:
            n, dist, prefixes = np.asarray(batch.column(2)), [], []
            maps = np.zeros((batch.num_rows, MAP_WORDS), dtype=np.uint64)
            for k, (size, pivot, delta) in enumerate(zip(n, np.asarray(batch.column(1)), batch.column(3), strict=True)):
                own = np.sort(np.asarray(delta.values))
                bit = own.view(np.uint64) % np.uint64(64 * MAP_WORDS)
                np.bitwise_or.at(maps[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                own = own[np.argsort(over[own & mask] > frequent, kind="stable")]
                most = (int(size) + int(size) * at.den // at.num) * (at.den - at.num) // (at.den + at.num) + 1
                dist.append(len(own))
                taken = own[: len(own) - max(1, len(own) - most) + 1]
                prefixes.append(mix(taken.view(np.uint64) + mix(np.array([pivot]).view(np.uint64), 12), 14).view(np.int64))
            lens = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(np.array(dist, dtype=np.int64)), *[pa.array(maps[:, w].view(np.int64)) for w in range(MAP_WORDS)],
                    pa.ListArray.from_arrays(pa.array(lens), pa.array(flat)),
                ],
                names=["uid", "pivot", "n", "dist", *MAPS, "prefix"],
            )

    return spokes.select("uid", "pivot", "n", "delta").mapInArrow(
        released(run), f"uid long, pivot long, n long, dist long, {', '.join(f'{m} long' for m in MAPS)}, prefix array<long>"
    )


def in_cells(rows: DataFrame, tokens: DataFrame, most: int, broadcast_rows: int) -> DataFrame:
    """``rows`` with the cells of their tokens: cell and side.

    ``tokens`` has the token of each row, and nothing else. A token of at most
    ``most`` rows (counted) is one cell, 0. The rows of a more frequent one are
    dealt to blocks by hash, and each two blocks are a cell, as are the pairs
    within one: so no task holds more than two blocks, and each pair of rows is
    in one cell. Side is 0 in a cell of one block, 1 and 2 in one of two.
    """
    hot = tokens.groupBy("token").count().where(F.col("count") > most).select("token", F.ceil(F.col("count") / most).cast("long").alias("blocks"))
    hot = materialize(hot, "hot-tokens")
    n = hot.count()
    if not n:
        return rows.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(0).cast("long")})
    placed = rows.join(F.broadcast(hot) if n <= broadcast_rows else hot, "token", "left")
    block, other = F.pmod(F.xxhash64(F.lit(23), "uid"), F.col("blocks")), F.col("other")
    dealt = placed.withColumn("block", block).withColumn(
        "other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    cell = F.least("block", other) * F.col("blocks") + F.greatest(F.col("block"), other)
    side = F.when(F.col("block") < other, 1).when(F.col("block") > other, 2).otherwise(0)
    zero = F.lit(0).cast("long")
    return dealt.select(*rows.columns, F.coalesce(cell, zero).alias("cell"), F.when(F.col("blocks").isNull(), zero).otherwise(side.cast("long")).alias("side"))


def cross_pairs(rows: DataFrame, at: Threshold) -> DataFrame:
    """Pairs of different components that meet in a prefix shingle, one row for each such shingle.

    Rows (token, cell, side, uid, comp, n, matches, pivot, dist, bitmap) come
    sorted by token and cell; a cell's rows are paired in blocks, in a cell of
    two sides across these. Rows with matches of 0 are those
    of differences: they pair within their pivot, the others across pivots.
    Of differences, a bit that one bitmap has and the other lacks is a
    difference not in common; of whole sets, each bit that differs is a shingle
    not in common. So bitmaps bound from above what two sets share; pairs whose
    bound is under what a link needs are no candidates. A row whose bitmap is
    all -1 has none and is not bounded.
    """

    def pairs_of(side, uid, comp, n, matches, pivot, dist, *maps) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(comp, return_counts=True)
        if len(values) < 2:
            return
        main = values[np.argmax(counts)]
        order = np.concatenate([np.flatnonzero(comp == main), np.flatnonzero(comp != main)])
        side, uid, comp, n, matches, pivot, dist = (c[order] for c in (side, uid, comp, n, matches, pivot, dist))
        bits = np.stack([c[order] for c in maps], axis=1)
        mapped = (bits != -1).any(axis=1)
        m, total = int(np.sum(comp != main)), len(uid)
        within = matches[0] == 0
        two_sided = side[0] > 0
        step = max(1, 500_000 // total)
        for lo in range(total - m, total, step):
            x = np.arange(lo, min(total, lo + step))
            y = np.arange(x[-1])
            ok = (y[None, :] < x[:, None]) & (comp[y][None, :] != comp[x][:, None])
            if two_sided:
                ok &= side[y][None, :] != side[x][:, None]
            nx, ny = n[x][:, None], n[y][None, :]
            ok &= at.den * np.minimum(nx, ny) >= at.num * np.maximum(nx, ny)
            same = pivot[y][None, :] == pivot[x][:, None]
            ok &= same if within else ~same
            if within:  # the distances to the pivot differ by no more than a link allows
                ok &= (at.den + at.num) * np.abs(dist[x][:, None] - dist[y][None, :]) <= (at.den - at.num) * (nx + ny)
            i, j = np.nonzero(ok)
            if within and len(i):
                bx, by, dx, dy = bits[x[i]], bits[y[j]], dist[x[i]], dist[y[j]]
                lacking = lambda a, b: np.bitwise_count((a & ~b).view(np.uint64)).sum(axis=1, dtype=np.int64)
                most = np.minimum(dx - lacking(bx, by), dy - lacking(by, bx))
                keep = 2 * (at.den + at.num) * most >= (at.den + at.num) * (dx + dy) - (at.den - at.num) * (n[x[i]] + n[y[j]])
                i, j = i[keep], j[keep]
            elif len(i):
                differing = np.bitwise_count((bits[x[i]] ^ bits[y[j]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                keep = (at.den + at.num) * differing <= (at.den - at.num) * (n[x[i]] + n[y[j]])
                keep |= ~(mapped[x[i]] & mapped[y[j]])
                i, j = i[keep], j[keep]
            if len(i):
                p, q = uid[x[i]], uid[y[j]]
                need = np.maximum(np.minimum(matches[x[i]], matches[y[j]]), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(need)], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [np.asarray(c).astype(np.int64) for c in batch.columns]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            token, cell = cols[:2]
            if not len(token):
                continue
            heads = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
            ends = np.append(heads[1:], len(token))
            many = (ends - heads > 1)[:-1]
            for lo, hi in zip(heads[:-1][many], ends[:-1][many], strict=True):
                yield from pairs_of(*(c[lo:hi] for c in cols[2:]))
            held = [c[heads[-1] :] for c in cols]
        if held and len(held[0]) > 1:
            yield from pairs_of(*held[2:])

    return rows.mapInArrow(released(run), "a long, b long, need long")


def link_documents(
    docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(8, 10), most_matches: int = 4, sketch_bits: int = 20,
    frequent: int = 200, broadcast_rows: int = 1_000_000, cell_rows: int = 50_000,
) -> DataFrame:
    """Near-duplicate components of documents under word-shingle Jaccard.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A
    document's set are its distinct ``width``-word shingles; with fewer words,
    the whole sequence is its one shingle; without words or text the set is
    empty and links to nothing. Returns doc_id, n_shingles (long) and
    component_id (the smallest doc_id reachable by links, itself included), one
    row for each doc_id.

    Rows without doc_id take no part and are not returned. Rows that repeat a
    doc_id are one document, which has the links of each of them and the size
    of the largest. An empty table gives an empty one; further columns are
    ignored. ``most_matches``, ``sketch_bits``, ``frequent``, ``broadcast_rows``
    and ``cell_rows`` change the cost only, never the result.
    """
    require(docs, "doc_id", "text")
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = frequency_sketch(docs, width, sketch_bits)
    sets = materialize(document_sets(docs, sketch, width, threshold, most_matches, frequent), "sets")
    filled = sets.where(F.col("n") > 0)
    classes = materialize(filled.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("uid")), "set-classes")
    members = materialize(
        filled.select("doc_id", "s1", "s2", "n").distinct().join(classes, ["s1", "s2", "n"]).select("doc_id", "uid"), "set-members"
    )
    # Documents with several rows hold their classes together.
    several = members.groupBy("doc_id").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where(F.col("a") != F.col("b"))
    ties = members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("uid").alias("b"))
    reps = filled.join(classes.select("s1", "s2", "n", F.col("uid").alias("doc_id")), ["s1", "s2", "n", "doc_id"], "left_semi")
    # Stars: classes that share keys with the pivot of each of these keys.
    keyed = reps.select(F.col("doc_id").alias("uid"), F.posexplode("keys").alias("at", "key"))
    pivots = keyed.groupBy("at", "key").agg(F.min("uid").alias("pivot"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    met = keyed.join(pivots.select("at", "key", "pivot"), ["at", "key"]).where(F.col("uid") != F.col("pivot"))
    near = met.groupBy(F.col("pivot").alias("a"), F.col("uid").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    spokes = materialize(near.where(F.col("keys") >= SHARED_KEYS).select("a", "b"), "spokes")
    measured = compared(docs, spokes, width, broadcast_rows)
    delta = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    close = 3 * F.col("shared") >= F.size("x") + F.size("y") - F.col("shared")
    measured = materialize(
        measured.select(
            "a", "b", reached(threshold).alias("linked"), F.size("y").cast("long").alias("n"),
            F.when(close, delta).alias("delta"), close.alias("close"),
        ),
        "measured",
    )
    stars = materialize(measured.where("linked").select("a", "b").unionByName(ties).distinct(), "stars")
    comps = connected_components(stars)
    # A class is seen from its most popular pivot (of those with one set).
    popular = measured.where("close").groupBy("a").agg(F.count(F.lit(1)).alias("spokes"))
    choice = Window.partitionBy("b").orderBy(F.desc("spokes"), "a")
    single = measured.where("close").select("a", "b").join(several.select(F.col("doc_id").alias("a")), "a", "left_anti")
    own = single.join(popular, "a").withColumn("r", F.row_number().over(choice)).where("r = 1").select("a", "b")
    own = materialize(own, "own-pivot")
    chosen = measured.where("close").join(own, ["a", "b"], "left_semi").select(F.col("b").alias("uid"), F.col("a").alias("pivot"), "n", "delta")
    differences = materialize(difference_prefixes(chosen, sketch, threshold, frequent), "differences")
    comp_of = comps.select(F.col("node").alias("uid"), "comp")
    nothing = F.lit(-1).cast("long")
    # Classes with a pivot, and pivots, are where many sets are much alike: they carry the bitmaps of their sets.
    with_pivot = own.select(F.col("b").alias("uid"), F.col("a").alias("pivot")).unionByName(own.select(F.col("a").alias("uid"), F.lit(None).cast("long").alias("pivot")))
    crowd = with_pivot.groupBy("uid").agg(F.max("pivot").alias("pivot"), F.lit(True).alias("crowded"))
    placed = (
        reps.select(F.col("doc_id").alias("uid"), F.col("n").cast("long").alias("n"), F.col("matches").cast("long").alias("matches"), *MAPS, "prefix")
        .join(crowd, "uid", "left")
        .select(
            "uid", "n", "matches", F.coalesce("pivot", "uid").alias("pivot"), nothing.alias("dist"),
            *[F.when(F.col("crowded"), F.col(m)).otherwise(nothing).alias(m) for m in MAPS], "prefix",
        )
        .unionByName(differences.select("uid", "n", F.lit(0).cast("long").alias("matches"), "pivot", "dist", *MAPS, "prefix"))
        .join(comp_of, "uid", "left")
        .select(F.explode("prefix").alias("token"), "uid", F.coalesce("comp", "uid").alias("comp"), "n", "matches", "pivot", "dist", *MAPS)
    )
    # Pairs across the stars' components.
    tokens = reps.select(F.explode("prefix").alias("token")).unionByName(differences.select(F.explode("prefix").alias("token")))
    celled = in_cells(placed, tokens, cell_rows, broadcast_rows).select("token", "cell", "side", *placed.columns[1:])
    counted = cross_pairs(celled.repartition("token", "cell").sortWithinPartitions("token", "cell"), threshold).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
    pairs = materialize(counted.where(F.col("shared") >= F.col("need")).select("a", "b", "shared"), "prefix-pairs")
    # One partner of each class first, the one with most prefix shingles in common: these links join most components.
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    first = materialize(pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("a", "b"), "first-pairs")
    found = materialize(compared(docs, first, width, broadcast_rows).where(reached(threshold)).select("a", "b").unionByName(stars), "links")
    joined = connected_components(found)
    # Of the others only those matter that lie between different components still.
    of = lambda c: joined.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = materialize(rest.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "other-pairs")
    links = compared(docs, rest, width, broadcast_rows).where(reached(threshold)).select("a", "b").unionByName(found)
    final = connected_components(links)
    of_class = members.join(final.select(F.col("node").alias("uid"), "comp"), "uid", "left").select(
        "doc_id", F.coalesce("comp", "uid").alias("component_id")
    )
    sizes = sets.groupBy("doc_id").agg(F.max("n").cast("long").alias("n_shingles"))
    found = of_class.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sizes.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(8, 10)) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id.

    All columns stay. Rows without doc_id stay; of rows that repeat a kept
    doc_id all stay.
    """
    linked = link_documents(docs, width, threshold).where(F.col("doc_id") != F.col("component_id"))
    copy = fresh_name(docs, "copy")
    return docs.join(linked.select(F.col("doc_id").alias(copy)), F.col("doc_id") == F.col(copy), "left_anti")
