"""Subgraphs: random induced, k-hop around positives, in-edge k-hop, snowball. Draws are in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..graph import Adjacency, both_ways, checkpointed, empty_like, first, induced, numbered, relabelled
from .structure import degrees


def first_by_hash(nodes: DataFrame, k: int, seed: int, salt: str) -> DataFrame:
    """The first k nodes in hash order."""
    return first(nodes.withColumn("_k", order_key(seed, salt, "node")), k, "_k", "node").drop("_k")


def compact(nodes: DataFrame) -> DataFrame:
    """node and idx, numbered from 0 in order of the node."""
    return numbered(nodes.select("node").distinct(), None, "node", name="idx")


def subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Induced edges with compact node numbers; an error if there are none."""
    out = relabelled(induced(edges, kept), compact(kept))
    if not out.limit(1).count():
        raise ValueError("the subgraph has no edges")
    return out


def random_induced(nodes: DataFrame, edges: DataFrame, max_nodes: int, seed: int) -> DataFrame:
    """Kept nodes (node, y): all if they fit, else a hash draw; if the draw has no positive but the graph has, its last node gives way to one."""
    if nodes.limit(max_nodes + 1).count() <= max_nodes:
        return nodes.select("node", "y")
    kept = checkpointed(first_by_hash(nodes.select("node", "y"), max_nodes, seed, "induced"))
    if kept.filter("y = 1").limit(1).count():
        return kept
    positive = first_by_hash(nodes.filter("y = 1").select("node", "y"), 1, seed, "positive")
    return first_by_hash(kept, max_nodes - 1, seed, "induced").unionAll(positive) if positive.count() else kept


def grown(near: Adjacency, kept: DataFrame, hops: int, *within: str) -> DataFrame:
    """kept(within..., node) and all nodes met in at most so many steps along near's lists, each search within its own key."""
    key = [*within, "node"]
    kept = frontier = checkpointed(kept.select(*key).distinct())
    for _ in range(hops):
        met = near.met(frontier.select(*within, F.col("node").alias("at"))).select(*key).distinct()
        frontier = checkpointed(met.join(kept, key, "left_anti"))
        if not frontier.limit(1).count():
            break
        kept = kept.unionAll(frontier)
    return kept


def enriched(nodes: DataFrame, edges: DataFrame, max_nodes: int, seed: int, hops: int = 2) -> DataFrame:
    """Nodes within so many undirected hops of a positive; over max_nodes negatives drop out at random, under it others fill up. Positives alone may exceed it."""
    kept = grown(Adjacency.of(both_ways(edges)), nodes.filter("y = 1"), hops)
    labelled = nodes.select("node", "y").join(kept, "node", "left_semi")
    positives, size = labelled.filter("y = 1"), labelled.count()
    if size > max_nodes:
        return positives.unionAll(first_by_hash(labelled.filter("y = 0"), max(0, max_nodes - positives.count()), seed, "trim"))
    rest = nodes.select("node", "y").join(kept, "node", "left_anti")
    return labelled.unionAll(first_by_hash(rest, max_nodes - size, seed, "fill")) if size < max_nodes else labelled


def incoming(edges: DataFrame) -> DataFrame:
    """at and node: from each edge's destination to its source."""
    return edges.select(F.col("dst").alias("at"), F.col("src").alias("node"))


def k_hop_in(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes from which a seed is reached along at most so many edges."""
    return grown(Adjacency.of(incoming(edges)), seeds, hops)


def seeds(nodes: DataFrame, edges: DataFrame, strategy: str = "top_sar_by_degree", k: int = 20) -> DataFrame:
    """Starting nodes: all positives; the k of highest total degree; or these among the positives (any other name; among all nodes if there is none)."""
    if strategy == "all_sar":
        return nodes.filter("y = 1").select("node")
    ranked = degrees(nodes, edges).join(nodes.select("node", "y"), "node")
    if strategy != "top_degree" and nodes.filter("y = 1").limit(1).count():
        ranked = ranked.filter("y = 1")
    return ranked.orderBy(F.col("deg").desc(), F.col("node").desc()).limit(k).select("node")


def snowball(nodes: DataFrame, edges: DataFrame, max_nodes: int, seed: int, *, k: int = 20, strategy: str = "top_sar_by_degree", waves: int = 15) -> tuple[DataFrame, DataFrame]:
    """Kept nodes (node, wave) and a row for each wave (wave, new_nodes, total_nodes).

    In a wave the frontier, in hash order, offers its neighbours, in hash order; a node belongs to its first offer, and
    new nodes are taken in order of their offers until max_nodes. Seeds are never cut.
    """
    spark = nodes.sparkSession
    both = Adjacency.of(both_ways(edges.filter("src <> dst")))
    kept = checkpointed(seeds(nodes, edges, strategy, k).withColumn("wave", F.lit(0)))
    total = kept.count()
    rows, frontier = [(0, total, total)], kept
    for wave in range(1, waves + 1):
        if total >= max_nodes:
            break
        offer = F.struct(order_key(seed, f"f{wave}", "at").alias("f"), order_key(seed, f"n{wave}", "node").alias("n"), F.col("node").alias("v"))
        offers = both.met(frontier.select(F.col("node").alias("at"))).groupBy("node").agg(F.min(offer).alias("x"))  # first, as many offer a hub
        offered = offers.join(kept.select("node"), "node", "left_anti")
        frontier = checkpointed(first(offered, max_nodes - total, "x").select("node", F.lit(wave).alias("wave")))
        new = frontier.count()
        if not new:
            break
        total += new
        rows.append((wave, new, total))
        kept = kept.unionAll(frontier)
    return kept, spark.createDataFrame(rows, "wave int, new_nodes long, total_nodes long") if rows else empty_like(spark, kept)


def top_hubs(degree: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes of highest total degree, ties to the greater node."""
    nth = F.row_number().over(W.orderBy(F.col("deg").desc(), F.col("node").desc()))
    return degree.orderBy(F.col("deg").desc(), F.col("node").desc()).limit(k).select(nth.alias("rank"), "node", "deg")
