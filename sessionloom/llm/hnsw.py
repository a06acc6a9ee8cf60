"""Nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are one node of the graph, so that a vector with many copies
doesn't close off its neighbourhood. Nodes are dealt to shards by a hash. A
shard's graph is built by insertion in rounds: the nodes of a round are
searched together in the graph so far, then linked by the usual diversity
rule. Graphs are stored as flat arrays: vectors, levels, and for each level a
matrix of neighbour numbers. Searches run in lockstep, a block of queries at a
time, and results of the shards are merged by exact score.

Inner products are searched as Euclidean distances after the one-dimension
lift x -> (x, sqrt(R^2 - |x|^2)), under which the nearest node to (q, 0) is the
one with the largest inner product.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import require
from .memory import released
from .scratch import materialize


class Graph:
    """One shard's graph, in flat arrays."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, seed: int = 1, breadth: int = 96):
        self.degree, self.breadth = degree, breadth
        norms = np.einsum("ij,ij->i", vectors, vectors)
        radius = float(norms.max(initial=0.0))
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(radius - norms, 0))[:, None]], axis=1)
        self.points = np.ascontiguousarray(lifted, dtype=np.float32)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        draws = -np.log(np.maximum(rng.random(n), 1e-12)) / np.log(degree)
        self.levels = np.minimum(draws.astype(np.int64), 6)
        # High nodes first, so that every level is connected from the top down.
        order = np.argsort(-self.levels, kind="stable")
        self.points, self.squares, self.levels = self.points[order], self.squares[order], self.levels[order]
        self.order = order
        self.top = int(self.levels[0]) if n else 0
        # Level l has the nodes 0 .. count-1, a prefix of the order.
        self.counts = [int(np.sum(self.levels >= lv)) for lv in range(self.top + 1)]
        self.links = [np.full((c, degree * (2 if lv == 0 else 1)), -1, dtype=np.int32) for lv, c in enumerate(self.counts)]
        for lv in range(self.top, -1, -1):
            self._build(lv)

    def _distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances (less the query's own square) of (q, m) nodes to q queries."""
        return self.squares[nodes] - 2 * np.einsum("qd,qmd->qm", queries, self.points[nodes])

    def search(self, queries: np.ndarray, level: int, entries: np.ndarray, breadth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of a block of queries in lockstep; nodes and distances, nearest first."""
        q = len(queries)
        rows = np.arange(q)
        seen = np.zeros((q, size), dtype=bool)
        width = entries.shape[1]
        ids = np.full((q, max(breadth, width)), -1, dtype=np.int64)
        far = np.full(ids.shape, np.inf, dtype=np.float32)
        ids[:, :width] = entries
        valid = entries >= 0
        far[:, :width] = np.where(valid, self._distances(queries, np.maximum(entries, 0)), np.inf)
        seen[np.repeat(rows, width)[valid.ravel()], entries[valid]] = True
        done = ~np.isfinite(far)
        links = self.links[level]
        live = rows
        while len(live):
            open_far = np.where(done[live], np.inf, far[live])
            pick = np.argmin(open_far, axis=1)
            going = np.isfinite(open_far[np.arange(len(live)), pick])
            live, pick = live[going], pick[going]
            if not len(live):
                break
            done[live, pick] = True
            around = links[ids[live, pick]].astype(np.int64)
            new = (around >= 0) & (around < size)
            safe = np.where(new, around, 0)
            new &= ~seen[live[:, None], safe]
            seen[np.repeat(live, new.sum(1)), safe[new]] = True
            found = np.where(new, self._distances(queries[live], safe), np.inf)
            all_far = np.concatenate([far[live], found], axis=1)
            keep = np.argpartition(all_far, breadth - 1, axis=1)[:, : ids.shape[1]]
            at = np.arange(len(live))[:, None]
            ids[live] = np.concatenate([ids[live], safe], axis=1)[at, keep]
            done[live] = np.concatenate([done[live], ~new], axis=1)[at, keep]
            far[live] = all_far[at, keep]
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def _choose(self, nodes: np.ndarray, far: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
        """The diversity rule for a block: a candidate is kept if no kept one is nearer to it than the node itself."""
        q, m = nodes.shape
        out = np.full((q, most), -1, dtype=np.int32)
        safe = np.maximum(nodes, 0)
        pts = self.points[safe]
        gram = np.einsum("qid,qjd->qij", pts, pts)
        sq = self.squares[safe]
        between = sq[:, :, None] + sq[:, None, :] - 2 * gram
        true_far = far + self.squares[own][:, None]
        kept = np.zeros((q, m), dtype=bool)
        count = np.zeros(q, dtype=np.int64)
        valid = np.isfinite(far) & (nodes != own[:, None])
        for j in range(m):
            near = np.where(kept[:, : j + 1], between[:, j, : j + 1], np.inf).min(axis=1)
            ok = valid[:, j] & (count < most) & (near >= true_far[:, j])
            kept[:, j] = ok
            out[ok, count[ok]] = nodes[ok, j]
            count += ok
        # Fill with the nearest left out.
        for j in range(m):
            ok = valid[:, j] & ~kept[:, j] & (count < most)
            out[ok, count[ok]] = nodes[ok, j]
            count += ok
        return out

    def _build(self, level: int) -> None:
        count, links = self.counts[level], self.links[level]
        most = links.shape[1]
        above = self.counts[level + 1] if level < self.top else 0
        size = above if above else min(count, 1)
        if above:  # nodes of the level above take their places among themselves first
            self._insert(level, 0, above, None)
        while size < count:
            block = min(count - size, max(16, min(size, 256)))
            self._insert(level, size, size + block, size)
            size += block
        del most

    def _insert(self, level: int, lo: int, hi: int, size: int | None) -> None:
        """Link nodes lo .. hi-1; searched among 0 .. size-1 and themselves (None: the nodes of the level above)."""
        links = self.links[level]
        most = links.shape[1]
        for start in range(lo, hi, 256):
            own = np.arange(start, min(hi, start + 256))
            queries = self.points[own]
            if size is None:
                nodes, far = self.descend(queries, level + 1, self.breadth)
                inside = None
            else:
                entries = self.descend(queries, level + 1, 1, size)[0][:, :1] if level < self.top else np.zeros((len(own), 1), dtype=np.int64)
                nodes, far = self.search(queries, level, entries, self.breadth, size)
                inside = np.broadcast_to(np.arange(lo, hi), (len(own), hi - lo))
            if inside is not None:
                nodes = np.concatenate([nodes, inside], axis=1)
                far = np.concatenate([far, np.where(inside == own[:, None], np.inf, self._distances(queries, inside))], axis=1)
            take = min(nodes.shape[1], self.breadth)
            order = np.argsort(far, axis=1, kind="stable")[:, :take]
            nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
            chosen = self._choose(nodes, far, own, most // 2)
            links[own, : most // 2] = chosen
            self._link_back(level, own, chosen)

    def _link_back(self, level: int, own: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[level]
        most = links.shape[1]
        ok = chosen >= 0
        targets, sources = chosen[ok].astype(np.int64), np.repeat(own, ok.sum(1))
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        heads = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]])) if len(targets) else np.empty(0, dtype=np.int64)
        if not len(heads):
            return
        touched = targets[heads]
        sizes = np.diff(np.append(heads, len(targets)))
        wide = np.full((len(touched), most + int(sizes.max())), -1, dtype=np.int64)
        wide[:, :most] = links[touched]
        slot = np.arange(len(targets)) - np.repeat(heads, sizes)
        wide[np.repeat(np.arange(len(touched)), sizes), most + slot] = sources
        # A source may be linked already.
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        for start in range(0, len(touched), 256):
            own_t, cand = touched[start : start + 256], wide[start : start + 256]
            far = np.where(cand >= 0, self._distances(self.points[own_t], np.maximum(cand, 0)), np.inf)
            order = np.argsort(far, axis=1, kind="stable")
            cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
            held = int((cand >= 0).sum(1).max())
            cand, far = cand[:, :held], far[:, :held]
            if held <= most:
                out = np.full((len(own_t), most), -1, dtype=np.int32)
                out[:, :held] = cand
            else:
                out = self._choose(cand, far, own_t, most)
            links[own_t] = out

    def descend(self, queries: np.ndarray, level: int, breadth: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Greedy descent from the top to ``level``, where the search has ``breadth``."""
        entries = np.zeros((len(queries), 1), dtype=np.int64)
        far = np.zeros((len(queries), 1), dtype=np.float32)
        for lv in range(self.top, level - 1, -1):
            wide = breadth if lv == level else 1
            size = self.counts[lv] if limit is None else min(self.counts[lv], max(limit, 1))
            entries, far = self.search(queries, lv, entries[:, :1], max(wide, 1), size)
        return entries, far

    def nearest(self, vectors: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (of the input) found for each query, nearest first, and whether they are valid."""
        queries = np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1).astype(np.float32)
        nodes, far = self.descend(queries, 0, breadth)
        return self.order[np.maximum(nodes, 0)], np.isfinite(far)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, points=self.points, levels=self.levels, order=self.order, meta=np.array([self.degree, self.breadth]),
            **{f"links{lv}": x for lv, x in enumerate(self.links)},
        )
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Graph:
        got = np.load(io.BytesIO(blob))
        g = cls.__new__(cls)
        g.degree, g.breadth = (int(v) for v in got["meta"])
        g.points, g.levels, g.order = got["points"], got["levels"], got["order"]
        g.squares = np.einsum("ij,ij->i", g.points, g.points)
        g.top = int(g.levels[0])
        g.counts = [int(np.sum(g.levels >= lv)) for lv in range(g.top + 1)]
        g.links = [got[f"links{lv}"] for lv in range(g.top + 1)]
        return g


def valid_vectors(df: DataFrame) -> DataFrame:
    """vec_id and embedding as double, of rows whose vector takes part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & e.isNotNull()).select("vec_id", e.cast("array<double>").alias("embedding")).where(
        finite & F.exists("embedding", lambda x: x != 0)
    )


def usual_length(rows: DataFrame) -> int:
    """The most frequent length of the vectors, the longer of equals; 0 without rows."""
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else 0


def _whole_partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _matrix(lists: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def search_vectors(
    df: DataFrame, query_every: int = 20, k: int = 20, shard_rows: int = 100_000, least_shards: int = 6, degree: int = 16,
    build_breadth: int = 80, search_breadth: int = 120, block: int = 200_000,
) -> DataFrame:
    """The ``k`` nearest rows by inner product of every row whose vec_id is divisible by ``query_every``.

    Returns query_id, rank (int from 1), vec_id and score (double: the inner
    product of the original vectors), nearest first, equal scores by smaller
    vec_id; all candidates if there are fewer than ``k``. A row is no candidate
    of its own. Vectors that are null, empty or zero, or hold null or
    non-finite components take no part, nor do rows without vec_id, nor vectors
    of another length than the most frequent one (the longer of two as
    frequent). Of rows that repeat a vec_id with the same vector one counts. An
    empty table gives an empty result; further columns are ignored.

    Every row is indexed. Of the rows of an equal vector the k + 1 smallest
    vec_ids can be among a query's nearest; they stand for the node. The number
    of shards is ``least_shards`` or what holds ``shard_rows`` nodes each. A
    shard's index goes to one task for each ``block`` queries; the queries of a
    task stream past it.
    """
    require(df, "vec_id", "embedding")
    rows = valid_vectors(df)
    rows = rows.where(F.size("embedding") == usual_length(rows)).distinct()
    by_vector = W.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    nodes = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("embedding")), "vectors")
    queries = materialize(
        rows.where(F.col("vec_id") % query_every == 0).select("vec_id", F.xxhash64("embedding").alias("node"), "embedding"), "vector-queries"
    )
    shards = max(least_shards, -(-nodes.count() // shard_rows))
    shard_of = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(shards)).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole_partition(batches)
        if table is not None:
            table = table.sort_by("node")
            vectors = _matrix(table["embedding"], table.num_rows)
            lists = table["ids"].combine_chunks()
            graph = Graph(vectors, degree, breadth=build_breadth)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "graph": [graph.dump()], "vectors": [vectors.tobytes()],
                "dim": pa.array([vectors.shape[1]], pa.int32()), "own": [lists.flatten().to_numpy().astype(np.int64).tobytes()],
                "lens": [lists.value_lengths().to_numpy().astype(np.int64).tobytes()],
            })

    # A partition for each shard, however their numbers hash.
    packed = "shard int, graph binary, vectors binary, dim int, own binary, lens binary"
    dealt = nodes.withColumn("shard", shard_of).repartitionById(shards, "shard")
    index = materialize(dealt.select("shard", "node", "embedding", "ids").mapInArrow(released(build), packed), "hnsw")
    # A query for each distinct vector to every shard, behind the shard's index.
    distinct = queries.select("node", "embedding").distinct()
    blocks = max(1, -(-queries.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = distinct.withColumn("block", F.pmod("node", F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    streamed = index.withColumn("block", every(blocks)).unionByName(asked, allowMissingColumns=True)
    task = (F.col("shard") * blocks + F.col("block")).cast("int")
    streamed = streamed.withColumn("task", task).repartitionById(shards * blocks, "task").sortWithinPartitions(F.col("graph").isNull(), "node")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            at = 0
            if graph is None:
                if not batch.num_rows or not batch["graph"][0].is_valid:
                    continue  # a shard without vectors
                at = 1  # the index comes first
                graph = Graph.load(batch["graph"][0].as_py())
                vectors = np.frombuffer(batch["vectors"][0].as_py()).reshape(-1, batch["dim"][0].as_py())
                ids, lens = (np.frombuffer(batch[c][0].as_py(), dtype=np.int64) for c in ("own", "lens"))
                starts = np.concatenate([[0], np.cumsum(lens)])
            for lo in range(at, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                q = _matrix(part["embedding"], part.num_rows)
                found, valid = graph.nearest(q, max(search_breadth, k + 1))
                scores = (vectors[found] * q[:, None, :]).sum(axis=2)
                out: list[tuple[np.ndarray, np.ndarray]] = []
                for i in range(part.num_rows):
                    own, s = found[i][valid[i]], scores[i][valid[i]]
                    rows = np.concatenate([np.arange(starts[f], starts[f + 1]) for f in own])
                    s = np.repeat(s, lens[own])
                    best = np.lexsort((ids[rows], -s))[: k + 1]
                    out.append((ids[rows[best]], s[best]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part["node"].to_numpy(), [len(x) for x, _ in out])), pa.array(np.concatenate([x for x, _ in out])),
                        pa.array(np.concatenate([y for _, y in out])),
                    ],
                    names=["node", "vec_id", "score"],
                )

    wanted = ["graph", "vectors", "dim", "own", "lens", "node", "embedding"]
    found = streamed.select(*wanted).mapInArrow(released(look), "node long, vec_id long, score double")
    nearest = W.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    lists = merged.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    own = queries.select(F.col("vec_id").alias("query_id"), "node").join(lists, "node")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score")
    )
