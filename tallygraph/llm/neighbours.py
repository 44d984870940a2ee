"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

A vector x of the greatest norm M gets one more component, sqrt(M^2 - |x|^2), and a query a zero: then the largest inner
product is the smallest Euclidean distance, a metric, and the triangle inequality may prune. A subtree is left out if its
nearest possible point, its bound times a factor, lies beyond the k-th neighbour found; factor 1 is exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, record, width

NEAREST = 20
FACTOR = 1.1
#: Rows of a shard, so that there is one for each task, and points of a leaf.
SHARD_ROWS, LEAF = (4096, 65536), 128
#: Shards whose results one group of the first merge holds.
MERGED = 64
#: Squares of distances this close, relative to the squared lengths, may be ties, which exact scores settle; and pairs held before they are reduced.
ROUNDING, HELD = 1e-11, 1 << 20


@dataclass
class Node:
    vantage: int
    inner: Node | np.ndarray
    outer: Node | np.ndarray
    inner_most: float
    outer_least: float


class VantageTree:
    """A tree over the distinct vectors of a shard; equal vectors are one point with their ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float) -> None:
        ids, first = np.unique(ids, return_index=True)
        vectors = vectors[first].astype(np.float64)
        self.points, point = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(point, kind="stable")
        self.ids, self.at = ids[order], np.searchsorted(point.ravel()[order], np.arange(len(self.points) + 1))
        lifted = np.sqrt(np.maximum(most - (self.points**2).sum(1), 0))
        self.lifted, self.most = np.concatenate([self.points, lifted[:, None]], 1), most
        self.random = np.random.default_rng(len(self.points))
        self.root = self.build(np.arange(len(self.points)))

    def build(self, members: np.ndarray) -> Node | np.ndarray:
        if len(members) <= LEAF:
            return members
        vantage = int(members[self.random.integers(len(members))])
        far = np.sqrt(np.maximum(((self.lifted[members] - self.lifted[vantage]) ** 2).sum(1), 0))
        order = np.argsort(far, kind="stable")
        half = len(members) // 2
        return Node(vantage, self.build(members[order[:half]]), self.build(members[order[half:]]), float(far[order[half - 1]]), float(far[order[half]]))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and score of the k best points found for each query, by score, then by the least id."""
        self.queries, self.squares, self.factor, self.k = queries, (queries**2).sum(1) + self.most, factor, k
        self.near, self.slack = np.full((len(queries), k), np.inf), ROUNDING * self.squares
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.visit(self.root, np.arange(len(queries)))
        return self.reduced()

    def reduced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs held the k best of each query, however many tie."""
        query, point = (np.concatenate([x[j] for x in self.pairs] or [np.zeros(0, np.int64)]) for j in range(2))
        score = np.concatenate([(self.queries[query[a : a + LEAF * LEAF]] * self.points[point[a : a + LEAF * LEAF]]).sum(1) for a in range(0, len(query), LEAF * LEAF)] or [np.zeros(0)])
        order = np.lexsort((self.ids[self.at[point]], -score, query))
        query, point, score = query[order], point[order], score[order]
        first = np.searchsorted(query, query)
        best = np.arange(len(query)) - first < self.k
        self.pairs, self.held = [(query[best], point[best])], int(best.sum())
        return query[best], point[best], score[best]

    def visit(self, node: Node | np.ndarray, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            square = np.maximum(self.squares[active, None] - 2 * (self.queries[active] @ self.points[node].T), 0)
            self.near[active] = np.partition(np.concatenate([self.near[active], square], 1), self.k - 1, 1)[:, : self.k]
            q, p = np.nonzero(square <= (self.near[active].max(1) + self.slack[active])[:, None])
            self.pairs.append((active[q], node[p]))
            self.held += len(q)
            if self.held > HELD + 2 * self.k * len(self.queries):
                self.reduced()
            return
        far = np.sqrt(np.maximum(self.squares[active] - 2 * (self.queries[active] @ self.points[node.vantage]), 0))
        inside = far < (node.inner_most + node.outer_least) / 2
        for first in (True, False):
            own, at = active[inside == first], far[inside == first]
            for inner in (first, not first):
                bound = at - node.inner_most if inner else node.outer_least - at
                reach = bound * self.factor <= np.sqrt(self.near[own].max(1)) + np.sqrt(self.slack[own])
                self.visit(node.inner if inner else node.outer, own[reach])

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[list[list[int]], list[list[float]]]:
        """Ids and inner products of each query's k nearest found, other than itself: nearest first, ties to smaller ids."""
        query, points, scores = self.search(queries.astype(np.float64), min(k + 1, max(len(self.points), 1)), factor)
        cut = np.searchsorted(query, np.arange(len(queries) + 1)).tolist()
        found: tuple[list, list] = ([], [])
        for a, b, own in zip(cut, cut[1:], ids.tolist(), strict=False):
            rows = sorted((-s, i) for s, p in zip(scores[a:b].tolist(), points[a:b].tolist(), strict=True) for i in self.ids[self.at[p] : min(self.at[p + 1], self.at[p] + k + 1)].tolist() if i != own)[:k]
            found[0].append([i for _, i in rows])
            found[1].append([-s for s, _ in rows])
        return found


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null, NaN or infinite component, and not all zeros."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & plain & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = NEAREST, factor: float = FACTOR, shard_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all other usable rows of its dimension.

    The rows are dealt by a hash of the id into shards of about shard_rows (by default within SHARD_ROWS); every shard
    meets the queries in blocks, as a stream: its tree is in memory, the queries pass. So every query is shuffled once for
    each shard: n rows of which a share q asks make n + q * n * n / shard_rows rows. Rows without an id or with an
    unusable vector take no part; a repeated id counts once; ties, however many, go to smaller ids (all of them at factor
    1, those found beyond it); other columns are not looked at; with fewer than k candidates all are returned, without any the query has no row.
    """
    spark = vectors.sparkSession
    base = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"), is_query.alias("asks"))
    norm = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    rows_of = lambda n: shard_rows or min(max(SHARD_ROWS[0], n // width(spark)), SHARD_ROWS[1])
    sizes = {r["dim"]: (r["most"], max(1, -(-r["n"] // rows_of(r["n"])))) for r in base.groupBy("dim").agg(F.max(norm).alias("most"), F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.element_at(F.create_map(*[F.lit(x) for d, (_, n) in sizes.items() for x in (d, n)]), F.col("dim"))
    held = base.select("dim", F.pmod(F.xxhash64("vec_id"), shards).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = base.filter("asks").select("dim", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    together = held.unionByName(asked).repartition(width(spark), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    most = {d: m for d, (m, _) in sizes.items()}
    schema = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            dims, shard, kind, ids = (batch.column(j).to_numpy() for j in range(4))
            column = batch.column(4)
            flat, at = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
            edges = np.flatnonzero(np.diff(dims) | np.diff(shard) | np.diff(kind)) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
                if a == b:
                    continue
                if (dims[a], shard[a]) != key:
                    key, held, tree = (dims[a], shard[a]), [], None
                block = flat[at[a] : at[b]].reshape(b - a, -1)
                if kind[a] == 0:
                    held.append((ids[a:b].copy(), block.copy()))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = VantageTree(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), most[int(dims[a])])
                names, scores = tree.nearest(ids[a:b], block, k, factor)
                yield record(schema, ids[a:b], np.full(b - a, shard[a] // MERGED, np.int32), names, scores)

    bounded_batches(spark)
    found = together.mapInArrow(search, "query_id long, part int, ids array<long>, scores array<double>")
    pairs = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("far"), i.alias("vec_id")))
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k).alias("near")
    merged = found.select("query_id", "part", pairs.alias("near")).groupBy("query_id", "part").agg(least("near")).groupBy("query_id").agg(least("near"))
    ranked = merged.select("query_id", F.posexplode("near").alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; every id divisible by 20 asks."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
