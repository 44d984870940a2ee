"""Clustering of integer vectors around centroids, each vector assigned by the threshold algorithm.

Every dimension has a list of the centroids ordered by their component. A vector walks all lists at once, outward from its own
value; a centroid met in any list is compared exactly. What no list has shown yet is at least as far in every dimension as
the list has come, so the sum of the squared gaps walked bounds it from below: once that strictly exceeds the best exact
distance, no other centroid is nearer or ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, record, written

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components below this stand for squared distances that fit into a long, up to 64 dimensions.
LARGEST = 1 << 27
#: Vectors that walk the lists together.
BLOCK = 512
_BEYOND, _NONE = 1 << 40, np.iinfo(np.int64).max


class CentroidLists:
    """The centroids' components of each dimension in order, and whose they are."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids.astype(np.int64)
        self.owner = np.argsort(self.centroids, axis=0, kind="stable").T
        inner = np.take_along_axis(self.centroids.T, self.owner, 1)
        ends = np.full((len(inner), 1), _BEYOND)
        self.values = np.concatenate([-ends, inner, ends], 1)  # an end is farther than any component
        self.owner = np.pad(self.owner, ((0, 0), (1, 1)))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's nearest centroid (ties: the smaller number), its squared distance, and the steps walked."""
        n, k, dims = len(vectors), len(self.centroids), np.arange(vectors.shape[1])
        exact, steps = np.full((n, k), _NONE), np.zeros(n, np.int64)
        right = np.stack([np.searchsorted(self.values[d], vectors[:, d]) for d in dims], 1) if len(dims) else np.zeros((n, 0), np.int64)
        left, own, x = right - 1, np.arange(n), vectors
        while len(own):
            below, above = x - self.values[dims, left], self.values[dims, right] - x
            down = below <= above
            met, gap = self.owner[dims, np.where(down, left, right)], np.where(down, below, above)
            left, right = left - down, right + ~down
            shown = np.zeros((len(own), k), bool)
            shown[np.arange(len(own))[:, None], met] = True
            row, centroid = np.nonzero(shown & (exact[own] == _NONE))
            exact[own[row], centroid] = ((x[row] - self.centroids[centroid]) ** 2).sum(1)
            steps[own] += 1
            held = exact[own]
            walk = ((gap**2).sum(1) <= held.min(1)) & (held == _NONE).any(1)  # with all centroids met nothing is left to bound
            own, x, left, right = own[walk], x[walk], left[walk], right[walk]
        cluster = exact.argmin(1)
        return cluster, exact[np.arange(n), cluster], steps

    def assigned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for any number of vectors, in blocks."""
        parts = [self.nearest(vectors[a : a + BLOCK])[:2] for a in range(0, len(vectors), BLOCK)]
        return tuple(np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int64)]) for j in range(2))


def integers(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the vectors that are kept."""
    v = F.col(vector_col)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    kept = vectors.filter(F.coalesce((F.size(v) == dimensions) & plain, F.lit(False)))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions).astype(np.int64)


def sums(table: DataFrame, lists: CentroidLists, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of each non-empty cluster: added up within tasks, then over tasks, a row for each cluster and task."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(lists.centroids), np.int64), np.zeros(lists.centroids.shape, np.int64)
        for batch in batches:
            v = matrix(batch.column(0), dimensions)
            cluster = lists.assigned(v)[0]
            order = np.argsort(cluster, kind="stable")
            has, first = np.unique(cluster[order], return_index=True)
            count[has] += np.diff([*first, len(order)])
            total[has] += np.add.reduceat(v[order], first, axis=0) if len(has) else 0
        has = np.flatnonzero(count)
        yield record(schema, has, count[has], [total[c].tolist() for c in has])

    added = table.select("v").mapInArrow(add_up, "cluster int, n long, total array<long>")
    whole = [F.sum(F.get("total", F.lit(d)).cast("decimal(20,0)")).alias(f"t{d}") for d in range(dimensions)]
    rows = added.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect()  # a row for each cluster
    return {r["cluster"]: (r["n"], [int(r[f"t{d}"]) for d in range(dimensions)]) for r in rows}


def starts(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash least, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(
    vectors: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, members and centroid for every vector that is kept.

    Only the k centroids meet in the driver; a round sends a row for each cluster and task. A vector that is null, of another
    number of components, or with a null, NaN, infinite or larger component (LARGEST after scaling) takes no part. A null id is
    assigned as others are and starts a centroid only where ids run out; repeated rows count each, and of rows with one id the
    lesser vector starts first; with fewer vectors than k each starts a centroid; other columns are not looked at; an empty
    table gives no rows. A sum of distances beyond a long is null.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    table = written(integers(vectors, id_col, vector_col, dimensions, scale), "integers")
    kind = table.schema["vec_id"].dataType.simpleString()
    centroids = starts(table, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, members long, centroid array<int>")
    for _ in range(rounds):
        for c, (n, total) in sums(table, CentroidLists(centroids), dimensions).items():
            centroids[c] = [t // n for t in total]
    lists = CentroidLists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, distance = lists.assigned(matrix(batch.column(1), dimensions))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = written(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: (int(r["d"]), r["n"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"), F.count(F.lit(1)).alias("n")).collect()}
    fits = lambda x: x if x <= _NONE else None
    every = fits(sum(d for d, _ in inertia.values()))
    facts = [(c, fits(d), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), n, centroids[c].tolist()) for c, (d, n) in inertia.items()]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, members long, centroid array<int>")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", *named.columns[1:])  # k rows


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components around 40 centroids."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same by comparing every vector with every centroid; sums of products of integers this small are exact in doubles."""
    nearest = lambda r: f"""a{r} AS MATERIALIZED (SELECT r, v, c, CAST(d AS BIGINT) AS d FROM (
      SELECT k.r, k.v, o.c, list_dot_product(k.w, k.w) - 2 * list_dot_product(k.w, o.w) + list_dot_product(o.w, o.w) AS d FROM kept k, c{r} o)
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""  # noqa: E731
    moved = lambda r: f"""m{r} AS (SELECT c, list(f ORDER BY i) AS v FROM (
      SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
        SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c),
      c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v, CAST(coalesce(m.v, o.v) AS DOUBLE[]) AS w FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c)"""  # noqa: E731
    steps = ",\n".join(f"{nearest(r)},\n{moved(r)}" for r in range(ROUNDS))
    return f"""WITH ints AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
    kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v, CAST(v AS DOUBLE[]) AS w FROM ints),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v, w FROM kept QUALIFY c < {CENTROIDS}),
    {steps},
    {nearest(ROUNDS)}
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(o.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN kept USING (r) JOIN c{ROUNDS} o ON a.c = o.c"""
