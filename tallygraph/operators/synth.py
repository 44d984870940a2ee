"""Synthetic graphs: degree-preserving rewiring, bootstrap of attributes, conversion and augmentation of sampled adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform
from ..graph import first as taken
from ..graph import numbered, shuffled


def rewired(edges: DataFrame, seed: int) -> DataFrame:
    """pos, src, dst: sources in order of node and edge matched with all destinations in hash order, so both degree sequences stay. A hub's edges are numbered by many tasks."""
    out = numbered(edges.select("src", "eid"), None, "src", "eid", name="pos", keep=("src",)).select("pos", "src")
    into = shuffled(edges.select("dst", "eid"), order_key(seed, "stubs", "eid"), "eid", name="pos").select("pos", "dst")
    return out.join(into, "pos")


def without_loops(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """Up to so many rounds in which the destinations of self-loops move on by one among them."""
    from pyspark.sql import Window as W

    for _ in range(rounds):
        bad = pairs.filter("src = dst")
        many = bad.count()
        if many < 2:
            break
        ordered = numbered(bad, None, "pos", name="nth")
        moved = ordered.select(F.pmod(F.col("nth") + 1, F.lit(many)).alias("nth"), F.col("dst").alias("moved"))
        fixed = ordered.join(moved, "nth").select("pos", "src", F.col("moved").alias("dst"))
        pairs = pairs.filter("src <> dst").unionByName(fixed)
    return pairs


def bootstrap(rows: DataFrame, n: int, seed: int, salt: str, *, key: str, columns: list[str], draws: int | None = None) -> DataFrame:
    """idx and the columns of rows drawn with replacement; rows carry key, numbered from 0 to n - 1. A row's columns stay together."""
    drawn = rows.sparkSession.range(n if draws is None else draws).select(F.col("id").alias("idx"), F.floor(uniform(order_key(seed, salt, "id")) * n).alias(key))
    return drawn.join(rows.select(key, *columns), key).select("idx", *columns)


def directed(pairs: DataFrame) -> DataFrame:
    """Both directions of undirected pairs u < v."""
    upper = pairs.filter("u < v").select("u", "v")
    return upper.unionAll(upper.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def augmented(spark: SparkSession, pairs: DataFrame, n: int, least: int, seed: int) -> DataFrame:
    """u, v: a two-way ring and hash-drawn two-way pairs added until there are so many directed edges, after at most 50 n draws; nothing if least < 1 or n < 2."""
    if least < 1 or n < 2:
        return pairs.select("u", "v").distinct()
    ring = spark.range(n).select(F.col("id").alias("u"), ((F.col("id") + 1) % n).alias("v"))
    ringed = pairs.select("u", "v").unionByName(ring).unionByName(ring.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    have = ringed.count()
    if have >= least:
        return ringed
    at = lambda salt: F.floor(uniform(order_key(seed, salt, "id")) * n).cast("long")
    draws = spark.range(50 * n).select("id", at("u").alias("a"), at("v").alias("b")).filter("a <> b")
    first = draws.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "id").groupBy("u", "v").agg(F.min("id").alias("id"))
    fresh = first.join(ringed, ["u", "v"], "left_anti")
    fresh = taken(fresh, -(-(least - have) // 2), "id").select("u", "v")
    return ringed.unionByName(fresh).unionByName(fresh.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
