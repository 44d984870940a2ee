"""From files to graphs: loading with features and splits, subgraph samples, synthetic graphs, and the sampler comparison."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform
from ..functions.scalars import bernoulli, entity_type
from ..graph import BROADCAST, PropertyGraph, checkpointed, induced, passing, relabelled, shuffled, stored, symmetrised
from ..operators import features, sampling, splits, structure, synth
from ..sources import csv
from .report import metadata

SAMPLING = ("random_induced", "fraud_enriched", "snowball")
#: Names fixed by the interface; balanced is short for balanced_edges.
SLICES = ("prefix", "balanced_edges", "balanced")


def load_graph(
    spark: SparkSession, folder: str, *, max_transactions: int | None = None, seed: int = 7, add_degree_features: bool = False, slice_mode: str = "prefix", balance_scan_rows: int = 2_000_000,
    target_edge_pos_fraction: float = 0.05, stratify_edges: bool = True, stratify_nodes: bool = True, lenient: bool = False,
) -> PropertyGraph:
    """Transactions and accounts as a graph with features, splits and metadata.

    slice_mode "prefix" takes the first rows, "balanced_edges" (or "balanced") draws max_transactions of the scanned ones with the wanted share
    of positives. Encoders are fitted on the whole slice. A missing account has the type Unknown and the median bank.
    """
    if slice_mode not in SLICES:
        raise ValueError(f"slice_mode {slice_mode!r} is none of {SLICES}")
    window = slice_mode != "prefix"
    if window and (not max_transactions or max_transactions < 1):
        raise ValueError(f"slice_mode {slice_mode!r} needs a positive max_transactions")
    paths = csv.resolve_paths(spark, folder)
    with passing(spark):
        with passing(spark):
            edges = csv.read_transactions(spark, paths.transactions, prefix=None if window else max_transactions, window=balance_scan_rows if window else None, lenient=lenient)
            if window:
                edges = stored(splits.balanced(edges, max_transactions, target_edge_pos_fraction, seed))
            listed = features.first_rows(csv.read_accounts(spark, paths.accounts), "account_id", "row_id").withColumn("type", entity_type(F.col("name")))
            index = stored(features.node_universe(listed.select("account_id", F.lit(0).alias("side"), F.col("row_id").alias("number")), edges))
            ids = index.select(F.col("account_id").alias("node"), F.col("node_idx").alias("idx"))
            edges = stored(relabelled(edges, ids, index.count() <= BROADCAST), lasting=True)
            nodes = stored(index.join(listed.select("account_id", "bank", F.col("type").alias("entity_type")), "account_id", "left").withColumnRenamed("node_idx", "node"), lasting=True)
        nodes = features.labelled(nodes, edges)
        nodes, node_columns = features.node_features(nodes, structure.degrees(nodes, edges).select("node", "in_deg", "out_deg") if add_degree_features else None)
        nodes = stored(splits.split(nodes, seed, key="node", stratify=stratify_nodes), lasting=True)
        edges = stored(splits.split(edges, seed, key="eid", stratify=stratify_edges), lasting=True)  # without their features, which are expressions
    for bank in ("from_bank", "to_bank"):
        edges = features.median_filled(edges, bank)
    edges, edge_columns = features.edge_features(edges)
    return PropertyGraph(nodes, edges, metadata(nodes, edges, len(node_columns), len(edge_columns)) | {"node_columns": node_columns, "edge_columns": edge_columns})


def load_scanned(spark: SparkSession, path: str, *, max_transactions: int = 200_000, balance_scan_rows: int = 1_000_000, target_edge_pos_fraction: float = 0.06, seed: int = 7) -> PropertyGraph:
    """nodes (node, y) and edges of the transaction file alone, for the statistics of samplers.

    All accounts of the scanned rows are nodes, numbered as rows are read; bad rows are skipped and blanks are 0; the slice's
    quota is truncated and leaves room for positives that are not there.
    """
    scanned = checkpointed(csv.read_transactions(spark, path, window=balance_scan_rows, lenient=True))
    index = checkpointed(features.interleaved_universe(scanned))
    drawn = splits.balanced(scanned, max_transactions, target_edge_pos_fraction, seed, truncated=True)
    edges = checkpointed(relabelled(drawn, index.select(F.col("account_id").alias("node"), F.col("node_idx").alias("idx"))).select("eid", "src", "dst", "amt", "y"))
    return PropertyGraph(checkpointed(features.labelled(index.select(F.col("node_idx").alias("node"), "account_id"), edges)), edges)


def from_files(spark: SparkSession, folder: str, real: PropertyGraph, seed: int = 7) -> PropertyGraph:
    """A stored graph with the real graph's feature columns, ready for training."""
    names = real.meta["node_columns"], real.meta["edge_columns"]
    g = csv.read_graph(spark, folder, node_width=len(names[0]), edge_width=len(names[1]), seed=seed)
    nodes, edges = checkpointed(csv.as_columns(g.nodes, "x", names[0])), checkpointed(csv.as_columns(g.edges, "edge_attr", names[1]))
    return PropertyGraph(nodes, edges, g.meta | {"generator": "from_files", "folder": folder})


def drawn(graph: PropertyGraph, sampling_mode: str, max_nodes: int, seed: int, *, hops: int = 2, top_k: int = 20, waves: int = 15, strategy: str = "top_sar_by_degree") -> PropertyGraph:
    """A subgraph with compact node numbers and no splits, perhaps without edges; an unknown mode is random_induced. Positives alone may exceed max_nodes."""
    if sampling_mode == "fraud_enriched":
        kept = sampling.enriched(graph.nodes, graph.edges, max_nodes, seed, hops).select("node")
    elif sampling_mode == "snowball":
        kept = sampling.snowball(graph.nodes, graph.edges, max_nodes, seed, k=top_k, strategy=strategy, waves=waves)[0].select("node")
    else:
        kept = sampling.random_induced(graph.nodes, graph.edges, max_nodes, seed).select("node")
    ids = checkpointed(sampling.compact(checkpointed(kept)))
    edges = checkpointed(relabelled(induced(graph.edges, ids), ids).drop("split"))
    nodes = graph.nodes.drop("split").join(ids, "node").drop("node").withColumnRenamed("idx", "node")
    return PropertyGraph(nodes, edges, graph.meta | {"sampling": sampling_mode})


def sampled(graph: PropertyGraph, sampling_mode: str, max_nodes: int, seed: int, **options: Any) -> PropertyGraph:
    """A subgraph as drawn with fresh splits; an error if it has no edges."""
    g = drawn(graph, sampling_mode, max_nodes, seed, **options)
    if not g.edges.limit(1).count():
        raise ValueError("the subgraph has no edges")
    return PropertyGraph(splits.split(g.nodes, seed, key="node"), splits.split(g.edges, seed + 1, key="eid"), g.meta)


def degree_preserving(graph: PropertyGraph, seed: int, *, allow_self_loops: bool = True) -> PropertyGraph:
    """A synthetic graph with the same degree sequences; nodes' and edges' attributes are drawn with replacement, each with its label."""
    edges = checkpointed(shuffled(graph.edges, order_key(seed, "rows", "eid"), "eid", name="row"))
    nodes = checkpointed(shuffled(graph.nodes, order_key(seed, "rows", "node"), "node", name="row"))
    n, m = nodes.count(), edges.count()
    wiring = synth.rewired(graph.edges, seed)
    wiring = wiring if allow_self_loops else synth.without_loops(checkpointed(wiring))
    edge_values = [c for c in edges.columns if c not in ("eid", "src", "dst", "split", "row")]
    node_values = [c for c in nodes.columns if c not in ("node", "account_id", "split", "row")]
    drawn_edges = synth.bootstrap(edges, m, seed, "edges", key="row", columns=edge_values)
    drawn_nodes = synth.bootstrap(nodes, n, seed, "nodes", key="row", columns=node_values)
    new_edges = wiring.join(drawn_edges.withColumnRenamed("idx", "pos"), "pos").withColumnRenamed("pos", "eid")
    new_nodes = sampling.compact(graph.nodes).join(drawn_nodes, "idx").drop("idx")
    return PropertyGraph(splits.split(checkpointed(new_nodes), seed, key="node"), splits.split(checkpointed(new_edges), seed, key="eid"), graph.meta | {"generator": "degree_preserving"})


def from_sample(spark: SparkSession, x: DataFrame, pairs: DataFrame, *, node_width: int, edge_width: int, edge_rate: float, seed: int, least_edges: int = 4096, rate_floor: float = 0.0) -> PropertyGraph:
    """An external generator's sample as a graph: x(node, features, y) with 0/1 class vectors by feature, pairs(u, v) of its adjacency.

    Both directions of u < v; a ring and drawn pairs up to least_edges (from the placeholder (0, 0) if there is no pair); zero
    edge vectors, labels drawn at edge_rate.
    """
    from ..functions.scalars import one_hot_class, resized

    edge_rate = min(0.5, max(0.0, edge_rate, rate_floor))
    held = F.transform("features", lambda v: one_hot_class(v).cast("float"))
    nodes = x.select("node", resized(held, node_width).alias("x"), F.greatest("y", F.lit(0)).cast("int").alias("y"))
    both = synth.directed(pairs)
    start = both if both.limit(1).count() else spark.createDataFrame([(0, 0)], "u long, v long")
    edges = checkpointed(synth.augmented(spark, start, x.count(), least_edges, seed))
    key = order_key(seed, "label", F.concat_ws("-", "u", "v"))
    named = shuffled(edges, order_key(seed, "eid", F.concat_ws("-", "u", "v")), "u", "v", name="eid")
    out = named.select("eid", F.col("u").alias("src"), F.col("v").alias("dst"), bernoulli(uniform(key), edge_rate).alias("y"), F.array_repeat(F.lit(0.0).cast("float"), edge_width).alias("edge_attr"))
    return PropertyGraph(splits.split(nodes, seed, key="node"), splits.split(checkpointed(out), seed + 1, key="eid"), {"generator": "sample", "edge_rate_drawn": edge_rate, "least_edges": least_edges})


def generator_input(graph: PropertyGraph, columns: list[str]) -> PropertyGraph:
    """What a generator trains on: node features as bits around their medians without constant ones, labels of at least 0, both directions of all edges but loops."""
    bits = features.median_bits(graph.nodes.select("node", F.greatest("y", F.lit(0)).alias("y"), *columns), columns)
    return PropertyGraph(bits, symmetrised(graph.edges))


def marginals(graph: PropertyGraph, columns: list[str]) -> DataFrame:
    """column, rate, rate_pos, rate_neg: means of the 0/1 columns over all nodes and by label."""
    y = F.col("y") == 1
    one = graph.nodes.agg(*[F.struct(F.avg(c).alias("rate"), F.avg(F.when(y, F.col(c))).alias("rate_pos"), F.avg(F.when(~y, F.col(c))).alias("rate_neg")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.column", "x.s.*")


def sampler_comparison(graph: PropertyGraph, max_nodes: int = 1200, seed: int = 7, *, top_k: int = 20, waves: int = 15) -> tuple[DataFrame, DataFrame]:
    """The graph's, a random induced and a snowball subgraph's statistics as rows (sample, ...), and the snowball's waves."""
    kept, rows = sampling.snowball(graph.nodes, graph.edges, max_nodes, seed, k=top_k, waves=waves)
    picked = {"full": graph.nodes.select("node"), "random": sampling.random_induced(graph.nodes, graph.edges, max_nodes, seed).select("node"), "snowball": kept.select("node")}
    out = None
    for name, nodes in picked.items():
        own = graph.nodes.select("node", "y").join(nodes, "node", "left_semi")
        edges = induced(graph.edges, nodes)
        one = structure.graph_stats(own, edges).crossJoin(F.broadcast(structure.by_label(structure.degrees(own, edges), own))).select(F.lit(name).alias("sample"), "*")
        out = one if out is None else out.unionByName(one)
    return out, rows
