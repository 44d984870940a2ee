"""Exact search for the greatest inner products of integer vectors with MaxScore, shard by shard.

The terms of a query are its non-zero components. Term d with a positive weight has as postings the vectors with a positive
component d, with a negative weight those with a negative one: there the term adds something, elsewhere it adds nothing or
takes away, so a score is at most the sum of what the postings add. A term's bound is its weight times the largest component
of its postings. Terms whose bounds together stay below the k-th score found are not essential: a vector in no essential
posting can't reach it. Essential postings are traversed; of what they show only vectors that can still reach the k-th score
are probed in the other terms, largest bound first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bounded_batches, record, width, written

BEST, SCALE, EVERY = 10, 1024, 100
#: Rows of a shard, so that there is one for each task.
SHARD_ROWS = (4096, 65536)
#: Vectors that are scored together, after which the k-th score is known better; terms probed between two looks at it.
BLOCK, PROBED = 4096, 8
_LONG = (1 << 63) - 1


class Postings:
    """Vectors of a shard with the postings of every dimension and sign, in blocks of consecutive vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, held = ids[order], vectors[order].astype(np.int64)
        most = int(np.abs(held).max(initial=0))
        self.exact = np.float64 if most * most * max(1, held.shape[1]) < 1 << 52 else np.int64  # sums of products are exact in either
        self.vectors = held.astype(self.exact)
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.blocks = [(a, min(a + BLOCK, len(ids))) for a in range(0, len(ids), BLOCK)]
        self.lists = [[(np.flatnonzero(c[a:b] > 0), np.flatnonzero(c[a:b] < 0)) for c in self.columns] for a, b in self.blocks]
        self.most = np.stack([self.vectors.max(0, initial=0), -self.vectors.min(0, initial=0)]) if len(ids) else np.zeros((2, held.shape[1]))

    def terms(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions in which the query is not zero by falling bound, and for each the sum of the bounds from it on, a zero at the end."""
        dims = np.flatnonzero(query)
        bound = np.abs(query[dims]) * self.most[(query[dims] < 0).astype(int), dims]
        order = np.argsort(-bound, kind="stable")
        rest = np.zeros(len(dims) + 1, bound.dtype)
        rest[:-1] = np.cumsum(bound[order][::-1])[::-1]
        return dims[order], rest

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors not of the query's id, best first, ties to smaller ids."""
        query = query.astype(self.exact)
        dims, rest = self.terms(query)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.exact)
        for (a, b), lists in zip(self.blocks, self.lists, strict=True):
            least = scores[k - 1] if len(scores) >= k else None
            if least is None or least <= 0:  # vectors in no posting are competitive too
                at = np.arange(a, b)
                found = self.vectors[a:b] @ query
            else:
                at, found = self.competitive(a, b, lists, query, dims, rest, least)
            keep = self.ids[at] != own
            ids, scores = np.concatenate([ids, self.ids[at][keep]]), np.concatenate([scores, found[keep]])
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
        return ids, scores.astype(np.int64)

    def competitive(self, a: int, b: int, lists: list, query: np.ndarray, dims: np.ndarray, rest: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the block's vectors that reach the k-th score; equal ones too, as ids decide."""
        essential = int(np.searchsorted(-rest, -least, "right"))  # bounds from there on add up to less than the k-th score
        added = np.zeros(b - a, self.exact)
        for d in dims[:essential].tolist():
            own = lists[d][int(query[d] < 0)]
            added[own] += query[d] * self.columns[d, a:b][own]
        at = np.flatnonzero((added > 0) & (added + rest[essential] >= least)) + a
        score = self.vectors[at][:, dims[:essential]] @ query[dims[:essential]]  # with what these terms take away
        for first in range(essential, len(dims) + 1, PROBED):
            reach = score + rest[first] >= least
            at, score = at[reach], score[reach]
            own = dims[first : first + PROBED]
            score = score + self.vectors[at][:, own] @ query[own]
        return at[score >= least], score[score >= least]


def usable(vector: Column, scale: int) -> Column:
    """Not null, no null, NaN or infinite component, and none so large that a score would not fit into a long."""
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(vector), F.lit(1)))
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) + 1 < most))
    return F.coalesce(vector.isNotNull() & plain, F.lit(False))


def top_products(vectors: DataFrame, is_query: Column, *, k: int = BEST, scale: int = SCALE, shard_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest inner products of floor(scale * x) with all other rows of its dimension.

    Rows are dealt by a hash of id and place into shards (SHARD_ROWS, by the number of tasks), so that repeated ones part too; the queries pass every shard
    as a stream, so n rows of which a share q asks shuffle n + q * n * n / shard_rows rows. Each task passes on k rows for a
    query. Rows without an id or with an unusable vector take no part; zero and empty vectors do. A repeated id asks once, with
    its least vector, and meets no row of its id; as candidates repeated rows count each. Ties go to smaller ids; other columns
    are not looked at; with fewer than k candidates all are returned, and an empty table or a lone row gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usual = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), scale))
    base = written(usual.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vector_col).alias("dim"), is_query.alias("asks")), "integers")
    rows_of = lambda n: shard_rows or min(max(SHARD_ROWS[0], n // width(spark)), SHARD_ROWS[1])
    sizes = {r["dim"]: max(1, -(-r["n"] // rows_of(r["n"]))) for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, n)]), F.col("dim"))
    held = base.select("dim", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), shards).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    asking = base.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = asking.select("dim", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    together = held.unionByName(asked).repartition(width(spark), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, postings = None, [], None
        for batch in batches:
            dims, shard, kind, ids = (batch.column(j).to_numpy() for j in range(4))
            column = batch.column(4)
            flat, at = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
            edges = np.flatnonzero(np.diff(dims) | np.diff(shard) | np.diff(kind)) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
                if a == b:
                    continue
                if (dims[a], shard[a]) != key:
                    key, rows, postings = (dims[a], shard[a]), [], None
                block = flat[at[a] : at[b]].reshape(b - a, int(dims[a]))
                if kind[a] == 0:
                    rows.append((ids[a:b].copy(), block.copy()))
                    continue
                if not rows:
                    continue
                if postings is None:
                    postings = Postings(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))
                found = [postings.best(own, query, k) for own, query in zip(ids[a:b].tolist(), block, strict=True)]
                yield record(schema, np.repeat(ids[a:b], [len(i) for i, _ in found]), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found]))

    found = together.mapInArrow(search, "query_id long, vec_id long, score long")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))  # limited to k within tasks before it is shuffled
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; every id divisible by 100 asks."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


def oracle() -> str:
    """Products of integers this small add up exactly in doubles."""
    return f"""WITH ints AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    asking AS (SELECT vec_id, min(v) AS v FROM ints WHERE vec_id % {EVERY} = 0 GROUP BY vec_id)
    SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank,
      c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM asking q JOIN ints c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) QUALIFY rank <= {BEST}"""
