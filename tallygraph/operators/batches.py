"""Minibatches of many training steps at once, and the surroundings each step sees: every row carries its step."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform
from ..graph import Adjacency, checkpointed
from .sampling import grown
from .splits import batch_quota, class_sizes


def share_drawn(take: int, size: int) -> float:
    """Share of a pool below which hashes are kept, so that nearly always at least take of them are."""
    return min(1.0, (take + 6 * math.sqrt(take) + 16) / max(size, 1))


def minibatches(pool: DataFrame, steps: int, batch: int, ratio: float, seed: int, *, key: str = "eid", first: int = 0) -> DataFrame:
    """step, key, y: for each step from first on the rows of pool(key, y) that come first in the step's own hash order, by class, as many as batch_quota says.

    Within a step no row is drawn twice; steps draw anew. A hash keeps few more rows than are drawn, so a class of a step is
    ranked by one task whatever the pool's size; should a step lack rows, all steps are drawn again from a larger share.
    """
    n, p = class_sizes(pool)
    quota = batch_quota(batch, ratio, p, n - p)
    order = order_key(seed, "batch", "step", key)
    every = pool.select(key, "y").withColumn("step", F.explode(F.sequence(F.lit(first), F.lit(first + steps - 1)))).withColumn("_order", order)
    shares = [share_drawn(quota[0], p), share_drawn(quota[1], n - p)]
    while True:
        drawn = checkpointed(every.filter(uniform(F.col("_order")) < F.when(F.col("y") == 1, F.lit(shares[0])).otherwise(F.lit(shares[1]))))
        least = {r["y"]: (r["least"], r["steps"]) for r in drawn.groupBy("step", "y").count().groupBy("y").agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("steps")).collect()}
        short = [k for k, take in enumerate(quota) if take and shares[k] < 1 and (least.get(1 - k, (0, 0))[0] < take or least[1 - k][1] < steps)]
        if not short:
            break
        shares = [min(1.0, 4 * x) if k in short else x for k, x in enumerate(shares)]
    nth = F.row_number().over(W.partitionBy("step", "y").orderBy("_order", key))
    return drawn.withColumn("_nth", nth).filter(F.col("_nth") <= F.when(F.col("y") == 1, quota[0]).otherwise(quota[1])).select("step", key, "y")


def batch_edges(batches: DataFrame, edges: DataFrame) -> DataFrame:
    """step, eid, src, dst of the edges of batches(step, eid)."""
    return batches.select("step", "eid").join(edges.select("eid", "src", "dst"), "eid").select("step", "eid", "src", "dst")


def batch_endpoints(drawn: DataFrame) -> DataFrame:
    """step and node: every end of a step's edges (step, src, dst), once."""
    return drawn.select("step", F.col("src").alias("node")).unionAll(drawn.select("step", "dst")).distinct()


def incoming_lists(edges: DataFrame) -> Adjacency:
    """Each node's incoming edges, parallel ones too: lists of (node, eid)."""
    return Adjacency.of(edges.select(F.col("dst").alias("at"), F.col("src").alias("node"), "eid"), distinct=False)


def surroundings(near: Adjacency, seeds: DataFrame, hops: int) -> DataFrame:
    """step and node: of each step the seeds(step, node) and all from which one of them is reached in so many edges; the searches of all steps are one."""
    return grown(near, seeds, hops, "step")


def surrounding_edges(near: Adjacency, kept: DataFrame) -> DataFrame:
    """step, eid, src, dst: the edges whose both ends a step has kept, parallel ones too."""
    into = near.met(kept.select("step", F.col("node").alias("at")))
    return into.join(kept, ["step", "node"], "left_semi").select("step", "eid", F.col("node").alias("src"), F.col("at").alias("dst"))


def local_edges(drawn: DataFrame, around: DataFrame) -> DataFrame:
    """step, eid, seen: for each edge drawn (step, eid, src, dst) the last one between its ends in the step's surroundings, whose attributes the step sees."""
    pair = ["step", "src", "dst"]
    last = around.join(drawn.select(*pair).distinct(), pair, "left_semi").groupBy(*pair).agg(F.max("eid").alias("seen"))
    return drawn.join(last, pair).select("step", "eid", "seen")
