"""Toxicity severity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - b_k) with one weight vector for all thresholds
b_1 < b_2 < ... The features are sparse: log(1 + count) of hashed words and
word beginnings. The severity grades come from the labels: grade 0 is labelled
clean; labelled toxic rows are graded 1 to ``grades`` by how many of their words
are marks of toxicity, that is, features frequent in toxic rows and next to
absent from clean ones.

The model is fitted on the driver from a bounded sample of labelled rows; every
document is scored, over its whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import fresh_name, require
from .memory import release, released

WORDS = re.compile(r"[^\W\d_]+").findall
#: Buckets of the hashed features.
BUCKETS = 1 << 22
#: A word gives itself and its beginnings of these lengths.
BEGINNINGS = (4, 5)
#: Words of a worker's memo.
MEMO = 250_000


def word_features(word: str) -> tuple[int, ...]:
    names = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names)


class _Memo(dict):
    """Word to its features, or to those of a vocabulary."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = word_features(word)
        if self.known is not None:
            found = tuple(self.known[f] for f in found if f in self.known)
        self[word] = found
        return found


def count_features(text: str | None, memo: _Memo) -> Counter:
    out: Counter = Counter()
    look = memo.__getitem__
    for found in filter(None, map(look, WORDS((text or "").lower()))):
        out.update(found)
    return out


@dataclass(frozen=True)
class OrdinalModel:
    features: tuple[int, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def exceedance(self, score: float) -> list[float]:
        """P(grade >= k) for k from 1."""
        return [1 / (1 + math.exp(min(50.0, max(-50.0, b - score)))) for b in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass(frozen=True)
class SparseRows:
    """A sparse matrix as triples."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.shape[0])

    def transposed_times(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * z[self.row], minlength=self.shape[1])


def fit_cumulative_link(x: SparseRows, y: np.ndarray, grades: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.05):
    """Weights and ascending thresholds by Adam on the exact likelihood."""
    n, v = x.shape
    w = np.zeros(v)
    share = np.array([(np.sum(y >= k) + 0.5) / (n + 1) for k in range(1, grades + 1)])
    first = -np.log(share / (1 - share))
    # b_1 free, then positive steps exp(s).
    p = np.concatenate([w, [first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w = p[:v]
        gaps = np.exp(p[v + 1 :])
        b = p[v] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x.times(w)
        ge = np.column_stack([np.ones(n), *[_sigmoid(z - bk) for bk in b], np.zeros(n)])
        prob = np.maximum(ge[np.arange(n), y] - ge[np.arange(n), y + 1], 1e-12)
        slope = ge * (1 - ge)  # of P(grade >= k) in z
        dz = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / prob / n
        db = np.zeros(grades)
        for k in range(1, grades + 1):
            d = np.where(y == k, slope[:, k], 0) - np.where(y + 1 == k, slope[:, k], 0)
            db[k - 1] = np.sum(d / prob) / n
        grad = np.concatenate([x.transposed_times(dz) + l2 * w, [db.sum()], [db[k:].sum() * gaps[k - 1] for k in range(1, grades)]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return p[:v], p[v] + np.concatenate([[0.0], np.cumsum(np.exp(p[v + 1 :]))])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_train: int = 8000, vocabulary: int = 2048, grades: int = 3
) -> OrdinalModel:
    """Fit on a sample of about ``max_train`` labelled rows at most.

    The sample takes the rows whose hashed doc_id falls under the rate that
    gives so many; with fewer labels it takes all. Labels without doc_id or
    toxic take no part; of a repeated doc_id the largest label counts. Without
    toxic or without clean rows the model has no weights and rejects nothing.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    keep = min(1.0, max_train / max(1, total))
    sample = known.where(F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1 << 30)) < F.lit(int(keep * (1 << 30))))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            counted = [count_features(x.as_py(), memo) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("toxic"),
                    pa.array([list(c) for c in counted], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())),
                ],
                names=["doc_id", "toxic", "ids", "counts"],
            )

    table = rows.mapInArrow(released(featurize), "doc_id long, toxic int, ids array<int>, counts array<int>").toArrow().sort_by("doc_id")
    toxic = table["toxic"].to_numpy() > 0
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return OrdinalModel((), (), (5.0,))
    flat = lambda name: table[name].combine_chunks().flatten().to_numpy()
    ids, counts = flat("ids"), flat("counts")
    row = np.repeat(np.arange(len(toxic)), table["ids"].combine_chunks().value_lengths().to_numpy())
    del table
    names, ids = np.unique(ids, return_inverse=True)  # the features of the sample, densely numbered
    ids, row = ids.astype(np.int32), row.astype(np.int32)
    bad = toxic[row]
    df1, df0 = (np.bincount(ids[side], minlength=len(names)) for side in (bad, ~bad))
    odds = np.log((df1 + 0.5) / (n1 + 1)) - np.log((df0 + 0.5) / (n0 + 1))
    strength = np.where(df1 >= min(5, max(1, n1 // 10)), odds * np.sqrt(df1), 0)
    chosen = np.argsort(-strength, kind="stable")[:vocabulary]
    chosen = chosen[strength[chosen] > 0]
    place = np.full(len(names), -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    used = place[ids] >= 0
    x = SparseRows(row[used], place[ids[used]], np.log1p(counts[used]), (len(toxic), len(chosen)))
    # Marks of toxicity: in a fiftieth of the toxic rows, at most a hundredth of that share of the clean ones.
    marks = (df1 >= max(2, n1 / 50)) & ((df0 + 0.5) / (n0 + 1) < 0.01 * df1 / n1 + 0.5 / (n0 + 1))
    marked = marks[ids]
    hits = np.bincount(row[marked], weights=counts[marked], minlength=len(toxic))
    cuts = np.unique(np.quantile(hits[toxic], [k / grades for k in range(1, grades)]))
    y = np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    levels = np.unique(y)
    y = np.searchsorted(levels, y)
    w, b = fit_cumulative_link(x, y, len(levels) - 1)
    return OrdinalModel(tuple(int(names[c]) for c in chosen), tuple(float(v) for v in w), tuple(float(v) for v in b))


def score_toxicity(docs: DataFrame, model: OrdinalModel, reject: float = 0.35) -> DataFrame:
    """``docs`` with ``expected_severity`` (double), ``grade`` (int) and ``toxic`` (boolean).

    Expected severity is the sum of P(grade >= k), to six decimals; the grade
    is the number of thresholds passed with probability of a half or more;
    toxic rows have P(grade >= 1) >= ``reject``. Columns of the input by those
    names are replaced. A null or empty text is scored by the thresholds alone.
    Every row gives one row, an empty table an empty one.
    """
    require(docs, "text")
    return _with_scores(docs, model, reject, "text")


def _with_scores(docs: DataFrame, model: OrdinalModel, reject: float, text: str) -> DataFrame:
    """Only the texts go through Python; the other columns wait in the JVM."""
    schema = T.StructType(
        [T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    )

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _Memo({f: i for i, f in enumerate(model.features)})
        weights, step = model.weights, 1 << 10
        try:
            for batch in texts:
                parts = []
                for lo in range(0, max(1, len(batch)), step):
                    out = []
                    for x in batch.slice(lo, step):
                        found = count_features(x.as_py(), memo)
                        out.append(model.exceedance(sum(weights[i] * math.log1p(n) for i, n in sorted(found.items()))))
                    parts.append(
                        pa.StructArray.from_arrays(
                            [
                                pa.array([round(sum(p), 6) for p in out], pa.float64()), pa.array([sum(q >= 0.5 for q in p) for p in out], pa.int32()),
                                pa.array([p[0] >= reject for p in out], pa.bool_()),
                            ],
                            names=schema.names,
                        )
                    )
                yield pa.concat_arrays(parts)
        finally:
            memo.clear()
            release()

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    score = F.arrow_udf(run, schema)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in schema.names]
    inner = fresh_name(docs, "score")
    return docs.select(*kept, score(F.col(text)).alias(inner)).select(*kept, *[F.col(f"{inner}.{c}").alias(c) for c in schema.names])


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the fitted model calls toxic."""
    model = fit_toxicity(docs, labels)
    names = {c: fresh_name(docs, c) for c in docs.columns if c in ("expected_severity", "grade", "toxic")}
    scored = score_toxicity(docs.withColumnsRenamed(names), model).where(~F.col("toxic"))
    return scored.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
