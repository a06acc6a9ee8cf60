"""Byte-level BPE by a hierarchical-bitmap rank queue.

One queue serves all new pre-tokens of a chunk at once, whatever their length.
The bytes lie in one doubly linked list with a wall after each pre-token; for
each merge rank a bucket holds the positions whose pair has that rank, and a
three-level bitmap of 64-bit words marks the ranks whose bucket is not empty.
Find-first-set on the bitmap gives the next rank; entries whose pair has
changed meanwhile are stale and skipped.

All live positions of a rank are merged together, left to right without
overlap, unless a merge of that rank can open a pair of the same or a lower
rank. Then only the leftmost position of each pre-token is merged and the
others go back, which is the order of a merge at a time.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import require
from .memory import released

_SHIFT = 20  # ids are below 2**20


class RankBitmap:
    """Set of ranks below 64**3 with find-first-set."""

    def __init__(self, size: int):
        if size > 64**3:
            raise ValueError("too many ranks")
        words = -(-size // 64)
        self.low = [0] * words
        self.mid = [0] * -(-words // 64)
        self.top = 0

    def add(self, rank: int) -> None:
        w = rank >> 6
        self.low[w] |= 1 << (rank & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def first(self) -> int:
        """The smallest rank, or -1."""
        if not self.top:
            return -1
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        w = (t << 6) + (m & -m).bit_length() - 1
        x = self.low[w]
        return (w << 6) + (x & -x).bit_length() - 1

    def remove(self, rank: int) -> None:
        w = rank >> 6
        self.low[w] &= ~(1 << (rank & 63))
        if not self.low[w]:
            self.mid[w >> 6] &= ~(1 << (w & 63))
            if not self.mid[w >> 6]:
                self.top &= ~(1 << (w >> 6))


class RankMerger:
    """Merges byte strings by a rank table, as one batch."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        if self.size > 1 << _SHIFT:
            raise ValueError("too many ranks")
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (ranks[token[:i]] << _SHIFT | ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], dtype=np.int64)
        left, right = self.pair_keys >> _SHIFT, self.pair_keys & ((1 << _SHIFT) - 1)
        #: Ranks whose merge can open a pair of the same or a lower rank.
        self.opens = np.zeros(self.size, dtype=bool)
        self.opens[left[self.pair_ranks <= left]] = True
        self.opens[right[self.pair_ranks <= right]] = True

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _SHIFT | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each."""
        counts = np.ones(len(pieces), dtype=np.int64)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)
        todo = np.flatnonzero(whole < 0)
        if len(todo):
            flat, counts[todo] = self._merge_all([pieces[i] for i in todo])
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(starts[-1], dtype=np.int64)
        single = np.flatnonzero(whole >= 0)
        ids[starts[single]] = whole[single]
        if len(todo):
            lens = counts[todo]
            ids[np.repeat(starts[todo] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())] = flat
        return ids, counts

    def _merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        n = int(lens.sum())
        if not n:
            return np.empty(0, dtype=np.int64), lens
        owner = np.repeat(np.arange(len(pieces)), lens)
        token = self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum(lens)[lens > 0]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.concatenate([[0], ends[:-1]])] = -1
        current = np.full(n, -1, dtype=np.int64)  # rank of the pair that starts here
        alive = np.ones(n, dtype=bool)
        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(self.size)
        marked = np.zeros(n, dtype=bool)
        narrow = np.uint16 if self.size <= 1 << 16 else np.int64  # 16 bits are sorted by radix

        def push(at: np.ndarray) -> None:
            ranks = current[at].astype(narrow)
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for hi in [*cuts.tolist(), len(at)]:
                rank = int(ranks[lo])
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = [at[lo:hi]]
                    queue.add(rank)
                else:
                    held.append(at[lo:hi])
                lo = hi

        at = np.flatnonzero(after >= 0)
        if len(at):
            current[at] = self._pair_rank(token[at], token[after[at]])
            at = at[current[at] >= 0]
            if len(at):
                push(at)
        while (rank := queue.first()) >= 0:
            queue.remove(rank)
            held = buckets.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[current[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                if len(held) > 1:
                    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if self.opens[rank]:
                own = owner[at]
                first = np.empty(len(at), dtype=bool)
                first[0] = True
                first[1:] = own[1:] != own[:-1]
                if not first.all():
                    buckets[rank] = [at[~first]]
                    queue.add(rank)
                    at = at[first]
            elif len(at) > 1:
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # overlapping pairs: every second one of a chain
                    index = np.arange(len(at))
                    heads = np.concatenate([[True], ~chained])
                    at = at[(index - np.maximum.accumulate(np.where(heads, index, 0))) % 2 == 0]
            right = after[at]
            token[at] = rank
            alive[right] = False
            current[right] = -1
            beyond = after[right]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            current[at] = -1
            prev = before[at]
            prev = prev[prev >= 0]
            marked[at] = True
            prev = prev[~marked[prev]]
            marked[at] = False
            touched = np.concatenate([at[has], prev])
            if len(touched):
                fresh = self._pair_rank(token[touched], token[after[touched]])
                current[touched] = fresh
                touched = touched[fresh >= 0]
                if len(touched):
                    push(touched)
        return token[alive], np.bincount(owner[alive], minlength=len(pieces))


# Letters and numbers that Unicode 16 adds to version 15.1, the one of this Python's tables.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
#: The code points with the property White_Space.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The one pattern that gets these classes.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _spans(points: Iterable[int]) -> str:
    """Code points in ascending order, as ranges of a character class."""
    spans: list[list[int]] = []
    for i in points:
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pre-token pattern.

    ``KNOWN`` is split as the tokenizer's own engine does, which has the
    letters and numbers of Unicode 16. The regex library may have another
    version: texts with a character on which the two differ go to a pattern
    that spells the categories out, all others to the library's classes. The
    most frequent alternative comes first (letters, numbers and contractions
    begin with different characters).
    """
    if pattern != KNOWN:
        return regex.compile(pattern).findall
    known = {"L": bytearray(sys.maxunicode + 1), "N": bytearray(sys.maxunicode + 1)}
    for letter, more in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        flags = known[letter]
        for i in range(sys.maxunicode + 1):
            flags[i] = unicodedata.category(chr(i))[0] == letter
        for first, last in more:
            flags[first : last + 1] = b"\x01" * (last + 1 - first)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    theirs = {k: {ord(c) for c in regex.findall(rf"\p{{{k}}}", everything)} for k in "LN"}
    odd = sorted({i for k in "LN" for i in range(sys.maxunicode + 1) if known[k][i] != (i in theirs[k]) and not 0xD800 <= i < 0xE000})
    space = WHITE_SPACE

    def compiled(letters: str, numbers: str) -> Callable[[str], list[str]]:
        return regex.compile(
            f" ?[{letters}]++| ?[{numbers}]++|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letters}{numbers}]++|[{space}]+(?![^{space}])|[{space}]+"
        ).findall

    quick = compiled(r"\p{L}", r"\p{N}")
    if not odd:
        return quick
    spelled = [_spans(i for i in range(sys.maxunicode + 1) if known[k][i]) for k in "LN"]
    exact: list[Callable[[str], list[str]]] = []
    has_odd = re.compile(f"[{_spans(odd)}]").search

    def split(text: str) -> list[str]:
        if text.isascii() or not has_odd(text):
            return quick(text)
        if not exact:
            exact.append(compiled(*spelled))
        return exact[0](text)

    return split


class _Pieces(dict):
    """Pre-token to its number; new ones are numbered and listed."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


#: Beyond this many characters a text is split in runs.
RUN_CHARS = 1 << 20


def runs_of(text: str, pattern: str) -> Iterator[str]:
    """A long text in runs of about ``RUN_CHARS`` that are split alike.

    ``KNOWN`` never matches across the place between a character that is no
    white space and a blank, and looks ahead only: such a place is the end of a
    match whatever follows it. Other patterns get the whole text.
    """
    at = 0
    while pattern == KNOWN and len(text) - at > RUN_CHARS:
        cut = text.find(" ", at + RUN_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Vocabulary:
    """Bytes of the tokens of a rank file, by id."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_len = np.array([len(t) for t in by_id], dtype=np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.blob = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        n = self.token_len[ids]
        total = int(n.sum())
        return self.blob[np.repeat(self.token_at[ids] - np.cumsum(n) + n, n) + np.arange(total)]


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}


class Codec:
    """Encoder and decoder of one rank file, with a bounded memo of pre-tokens."""

    def __init__(self, rank_file: bytes, pattern: str, memo: int = 150_000):
        ranks = read_ranks(rank_file)
        self.merger = RankMerger(ranks)
        self.pattern = pattern
        self.split = splitter(pattern)
        self.memo = memo
        self.vocabulary = Vocabulary(ranks)
        self.forget()

    def forget(self) -> None:
        self.pieces = _Pieces()
        self.ids = np.empty(0, dtype=np.int32)
        self.counts = np.empty(0, dtype=np.int64)

    def _learn(self) -> None:
        """Merge the pre-tokens that are new."""
        if self.pieces.fresh:
            ids, counts = self.merger.merge([p.encode("utf-8") for p in self.pieces.fresh])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts])
            self.pieces.fresh.clear()

    def _ids_of(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        self._learn()
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        out = []
        for own in numbers:
            n = self.counts[own]
            total = int(n.sum())
            out.append(self.ids[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(total)])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (int32) and the number of ids of each text.

        Whenever the memo is full, also within a text of several runs, the ids
        so far are made and the memo begins anew.
        """
        flat: list[np.ndarray] = []
        owner: list[int] = []
        held: list[np.ndarray] = []
        for i, text in enumerate(texts):
            for run in runs_of(text, self.pattern):
                held.append(np.fromiter(map(self.pieces.__getitem__, self.split(run)), dtype=np.int32))
                owner.append(i)
                if len(self.pieces) > self.memo:
                    flat += self._ids_of(held)
                    held.clear()
                    self.forget()
        flat += self._ids_of(held)
        lens = np.bincount(owner, weights=[len(x) for x in flat], minlength=len(texts)).astype(np.int64)
        return (np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)), lens

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        return self.vocabulary.decode(ids)


_CODECS: dict[tuple[int, int, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each worker process."""
    key = (len(rank_file), hash(rank_file), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def forget_codecs() -> None:
    """Empty the memos; the tables of the rank file stay for the worker's next task."""
    for own in _CODECS.values():
        own.forget()


def _chunks(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _list_bytes(own: Codec | Vocabulary, lists: pa.ListArray) -> pa.Array:
    return pa.array([own.decode(np.asarray(x.values)).tobytes() if x.is_valid else b"" for x in lists], pa.binary())


def encode_tokens(
    docs: DataFrame, rank_path: str, pattern: str, keep: list[str] | None = None, text: str = "text", chunk_chars: int = 3 << 20, decoded: bool = False
) -> DataFrame:
    """Token ids of every whole text, as column ``ids`` array<int>.

    ``rank_path`` is a rank file on the driver; its bytes (a fixed vocabulary)
    are broadcast. Each match of ``pattern`` is encoded by itself, without
    special tokens. Returns the columns ``keep`` (all but ``text`` if none are
    named; a column named ``ids`` is replaced) and ``ids``; with ``decoded``
    also the bytes that the ids decode to, as ``decode_tokens`` gives them,
    without a second way through Python. A null or empty text has no ids. Every
    row gives one row; an empty table gives an empty one.
    """
    require(docs, text)
    added = ("ids", "decoded") if decoded else ("ids",)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, *added)]
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType(fields + ([T.StructField("decoded", T.BinaryType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(len(keep)))
            done = 0
            for chunk in _chunks(texts, chunk_chars):
                ids, lens = own.encode(chunk)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
                rows = batch.slice(done, len(chunk))
                done += len(chunk)
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                more = [_list_bytes(own, lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], lists, *more], names=[*keep, *added])

    return docs.select(*[f"`{c}`" for c in keep], text).mapInArrow(released(run, forget_codecs), schema)


def decode_tokens(df: DataFrame, rank_path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` binary, the bytes of each row's ids (null ids: no bytes)."""
    require(df, ids)
    df = df.drop("decoded")
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(read_ranks(ranks.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _list_bytes(own, batch.column(at))], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(released(run), schema)
