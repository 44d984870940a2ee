"""Degrees, density, clustering, path lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..graph import BROADCAST, Adjacency, endpoints, first, neighbours, numbered, simple, stored


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_deg, out_deg, deg: parallel edges and self-loops count, nodes without edges have 0."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return nodes.select("node").join(counted, "node", "left").select("node", zero("in_deg"), zero("out_deg")).withColumn("deg", F.col("in_deg") + F.col("out_deg"))


def histogram(degree: DataFrame, column: str) -> DataFrame:
    """deg and n for every degree that occurs."""
    return degree.groupBy(F.col(column).alias("deg")).agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(degree: DataFrame, column: str) -> DataFrame:
    """deg and n for every degree from 0 to the greatest."""
    counted = histogram(degree, column)
    every = counted.agg(F.max("deg").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("top", F.lit(0)).cast("long"))).alias("deg"))
    return every.join(counted, "deg", "left").select("deg", F.coalesce("n", F.lit(0)).alias("n"))


def by_label(degree: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean and greatest in- and out-degree of positive and of other nodes, and their numbers; NULL for an empty group."""
    held = degree.join(labels.select("node", "y"), "node")
    parts: list[Column] = []
    for name, y in (("pos", 1), ("neg", 0)):
        own = F.col("y") == y
        for c in ("in_deg", "out_deg"):
            parts += [F.round(F.avg(F.when(own, F.col(c))), 6).alias(f"{name}_{c}_mean"), F.max(F.when(own, F.col(c))).alias(f"{name}_{c}_max")]
        parts.append(F.count(F.when(own, 1)).alias(f"{name}_n"))
    return held.agg(*parts)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density E / max(1, N (N - 1)), average degree 2 E / max(1, N), isolated nodes, shares of positive edges and nodes."""
    size = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("y").alias("node_rate"))
    flow = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.avg("y").alias("edge_rate"))
    alone = nodes.join(endpoints(edges), "node", "left_anti").agg(F.count(F.lit(1)).alias("n_isolated"))
    one = size.crossJoin(F.broadcast(flow)).crossJoin(F.broadcast(alone))  # one row each
    n, e = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    return one.select(
        "n_nodes", "n_edges", "n_isolated", F.round(e / F.greatest(F.lit(1.0), n * (n - 1)), 6).alias("density"), F.round(2 * e / F.greatest(F.lit(1.0), n), 6).alias("avg_degree"),
        F.round("node_rate", 6).alias("node_rate"), F.round("edge_rate", 6).alias("edge_rate"),
    )


def clustering(nodes: DataFrame, edges: DataFrame, max_edges: int | None = None) -> DataFrame:
    """One row, avg_clustering: mean of local_clustering over all nodes."""
    return local_clustering(nodes, edges, max_edges).agg(F.round(F.avg("local"), 6).alias("avg_clustering"))


def local_clustering(nodes: DataFrame, edges: DataFrame, max_edges: int | None = None) -> DataFrame:
    """node and local: 2 T / (d (d - 1)), 0 where d < 2, on the simple projection.

    Every pair is directed from its end of lower degree, so a hub starts few wedges; each triangle is found once.
    """
    pairs = simple(edges, max_edges)
    degree = neighbours(pairs).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    du, dv = degree.select(F.col("node").alias("u"), F.col("d").alias("du")), degree.select(F.col("node").alias("v"), F.col("d").alias("dv"))
    ranked = pairs.join(du, "u").join(dv, "v")
    low = F.struct("du", "u") < F.struct("dv", "v")
    out = ranked.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedges = out.select("a", F.col("b").alias("x")).join(out.select("a", F.col("b").alias("y")), "a").filter("x < y")
    closed = wedges.join(out.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), ["x", "y"])
    corners = closed.select(F.explode(F.array("a", "x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    d = F.col("d").cast("double")
    local = F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return nodes.select("node").join(degree, "node", "left").join(corners, "node", "left").select("node", F.coalesce(local, F.lit(0.0)).alias("local"))


def path_sources(nodes: DataFrame, sources: int, seed: int) -> DataFrame:
    """The first nodes in hash order."""
    return first(nodes.select("node", order_key(seed, "paths", "node").alias("_k")), sources, "_k", "node").select("node")


#: Searches that share a row, a bit each.
WORD = 64


def distances(start: DataFrame, edges: DataFrame, cutoff: int, max_edges: int | None = None) -> DataFrame:
    """source, at, dist: nodes within the cutoff of each node of start, itself at 0, along edges either way; the searches are one.

    A node has a row for each WORD sources: seen, a bit for each that reached it, and new, those that did in the last wave. What
    is stored are the pairs, once, in ranges, and these rows for each wave. A wave of up to BROADCAST rows is sent to the pairs;
    a larger one meets them by key, a hub's in blocks.
    """
    pairs = stored(simple(edges, max_edges).repartitionByRange("u", "v").distinct())
    links = neighbours(pairs).select(F.col("node").alias("at"), F.col("other").alias("node"))
    ids = numbered(start.select("node").distinct(), None, "node", name="n")
    many, word = ids.count(), F.floor(F.col("n") / WORD).cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, cast(n % {WORD} AS int))")
    state = stored(ids.select(F.col("node").alias("at"), word, bit.alias("seen"), bit.alias("new")))
    waves, dealt = [state.withColumn("dist", F.lit(0))], None
    for k in range(1, cutoff + 1):
        last = state.filter("new <> 0").select("at", "word", "new")
        n = last.count()
        if not n:
            break
        if n > BROADCAST:
            dealt = dealt or Adjacency.over(links)
        met = dealt.met(last) if n > BROADCAST else links.join(F.broadcast(last), "at")
        got = met.groupBy("node", "word").agg(F.bit_or("new").alias("got"))
        both = state.select("at", "word", "seen", F.lit(0).cast("long").alias("got")).unionAll(got.select("node", "word", F.lit(0).cast("long"), "got"))
        merged = both.groupBy("at", "word").agg(F.bit_or("seen").alias("had"), F.bit_or("got").alias("got"))
        state = stored(merged.select("at", "word", F.col("had").bitwiseOR(F.col("got")).alias("seen"), F.col("got").bitwiseAND(F.bitwise_not("had")).alias("new")))
        waves.append(state.filter("new <> 0").withColumn("dist", F.lit(k)))
    every = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("new", i) == 1))
    reached = reduce(DataFrame.unionAll, waves).select("at", "dist", "word", every.alias("bit")).select("at", "dist", (F.col("word").cast("long") * WORD + F.col("bit")).alias("n"))
    named = ids.select("n", F.col("node").alias("source"))
    return reached.join(F.broadcast(named) if many <= BROADCAST else named, "n").select("source", "at", "dist")


def path_lengths(nodes: DataFrame, edges: DataFrame, *, sources: int = 2000, seed: int = 7, cutoff: int = 10, max_edges: int | None = None) -> DataFrame:
    """One row, path_mean, path_median, n_pairs, of distances up to the cutoff from sources drawn by hash to other nodes."""
    far = distances(path_sources(nodes, sources, seed), edges, cutoff, max_edges).filter("dist > 0")
    return far.agg(F.round(F.avg("dist"), 6).alias("path_mean"), F.median("dist").alias("path_median"), F.count(F.lit(1)).alias("n_pairs"))
