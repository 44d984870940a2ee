"""Reports: nullable differences, JSON that holds no NaN, dataset metadata, names of result files."""

from __future__ import annotations

import json
import math
from functools import reduce
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..graph import checkpointed
from ..operators import metrics, similarity, splits, structure

#: Edges of the slice whose clustering and distances the comparison gives, as in the reference.
MAX_EDGES = 2_000_000


def drops(rows: DataFrame) -> DataFrame:
    """name and drop, real less transfer; NULL where either is missing or not finite."""
    return rows.select("name", (finite(F.col("real")) - finite(F.col("transfer"))).alias("drop"))


def sanitised(x: Any) -> Any:
    """Plain JSON values: NaN and infinities as None, numpy scalars and arrays and tuples as numbers and lists."""
    if isinstance(x, dict):
        return {str(k): sanitised(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [sanitised(v) for v in x]
    if isinstance(x, np.ndarray):
        return sanitised(x.tolist())
    if isinstance(x, np.generic):
        return sanitised(x.item())
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(path: str, report: dict) -> None:
    """A report on the driver's disk, indented, without NaN."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(sanitised(report), indent=2, allow_nan=False))


def as_json(columns: dict[str, Column]) -> Column:
    """The columns as one JSON text with nulls kept and NaN as null."""
    return F.to_json(F.struct(*[finite(c).alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def result_name(nodes: int, edges: int, cap: int, tag: str, *, edges_only: bool = False, private: bool = False) -> str:
    return f"transfer_hi_small_n{nodes}_e{edges}_m{cap}_{tag}{'_edgesonly' * edges_only}{'_dp' * private}.json"


def metadata(nodes: DataFrame, edges: DataFrame, node_width: int, edge_width: int) -> dict:
    """Sizes, rates, widths and, where rows are split, counts by split and class."""
    one = structure.graph_stats(nodes, edges).collect()[0].asDict()
    out = one | {"node_width": node_width, "edge_width": edge_width}
    for name, df in (("node_splits", nodes), ("edge_splits", edges)):
        if "split" in df.columns:
            out[name] = {r["split"]: {k: r[k] for k in ("n", "pos", "neg")} for r in splits.split_counts(df).collect()}
    return out


NAMES = ("real", "syn")


def compared(real: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], *, node_columns: list[str], edge_columns: list[str], sources: int = 2000, cutoff: int = 10, seed: int = 7) -> DataFrame:
    """key and value: how alike two graphs (nodes, edges) are in structure and features, and degrees by label of each.

    Both graphs go through every plan as one, each row tagged with its graph, so they share all shuffles; what comes out is
    a row for each figure. Keys are the report's, levels parted by dots. Clustering and distances are of the first MAX_EDGES edges.
    """
    tag = lambda c, k: F.struct(F.lit(k).alias("g"), F.col(c).alias("id")).alias(c)
    node_rows = [df.select(tag("node", k), F.lit(k).alias("g"), F.col("y").cast("int").alias("y"), *node_columns) for k, (df, _) in enumerate((real, synthetic))]
    edge_rows = [df.select(F.col("eid").cast("long").alias("eid"), tag("src", k), tag("dst", k), F.lit(k).alias("g"), F.col("y").cast("int").alias("y"), *edge_columns) for k, (_, df) in enumerate((real, synthetic))]
    nodes, edges = checkpointed(node_rows[0].unionByName(node_rows[1])), checkpointed(edge_rows[0].unionByName(edge_rows[1]))
    row = lambda key, value: F.struct(key.alias("key"), value.cast("double").alias("value"))
    name = F.when(F.col("g") == 0, NAMES[0]).otherwise(NAMES[1])
    keyed = lambda df, figures: df.select(F.explode(F.array(*[row(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in key]), value) for key, value in figures])).alias("x")).select("x.*")

    degree = checkpointed(structure.degrees(nodes, edges).join(nodes.select("node", "g", "y"), "node"))
    risky, clean = F.col("y") == 1, F.col("y") == 0
    mean = lambda when, c: F.avg(F.when(when, F.col(c)))
    by_graph = degree.groupBy("g").agg(
        F.avg("in_deg").alias("in"), F.avg("out_deg").alias("out"), mean(risky, "in_deg").alias("ri"), mean(risky, "out_deg").alias("ro"), mean(clean, "in_deg").alias("ci"), mean(clean, "out_deg").alias("co"),
        F.avg(risky.cast("int")).alias("rf"), F.avg("y").alias("yn"),
    )
    label = "fraud_patterns.node_degree_by_label."
    parts = [keyed(by_graph, [
        (("degree.", name, ".in_deg_mean"), F.col("in")), (("degree.", name, ".out_deg_mean"), F.col("out")), ((label, name, ".sar_in_mean"), F.col("ri")), ((label, name, ".sar_out_mean"), F.col("ro")),
        ((label, name, ".clean_in_mean"), F.col("ci")), ((label, name, ".clean_out_mean"), F.col("co")), ((label, name, ".sar_frac"), F.col("rf")), (("label_rates.node_pos_rate_", name), F.col("yn")),
    ])]
    parts.append(keyed(edges.groupBy("g").agg(F.avg("y").alias("ye")), [(("label_rates.edge_pos_rate_", name), F.col("ye"))]))
    count = lambda k: F.sum(F.when(F.col("g") == k, F.col("n")).otherwise(0))
    hist = degree.groupBy("g", "in_deg").agg(F.count(F.lit(1)).alias("n")).groupBy("in_deg").agg(F.abs(count(0) - count(1)).alias("gap"), count(0).alias("a"), count(1).alias("b"))
    top = lambda c: F.max(F.when(F.col(c) > 0, F.col("in_deg")))
    ends = hist.agg(top("a").alias("r"), top("b").alias("s"))
    l1 = hist.crossJoin(F.broadcast(ends)).agg(F.sum(F.when((F.col("s") >= F.col("r")) & (F.col("in_deg") <= F.col("r")), F.col("gap"))).alias("l1"))  # one row
    parts.append(keyed(l1, [(("degree.in_deg_hist_l1",), F.col("l1"))]))
    local = structure.local_clustering(nodes, edges, MAX_EDGES).groupBy(F.col("node.g").alias("g")).agg(F.avg("local").alias("c"))
    parts.append(keyed(local, [(("clustering_undirected.", name), F.col("c"))]))
    start = [structure.path_sources(df, sources, seed).select(tag("node", k)) for k, (df, _) in enumerate((real, synthetic))]
    far = structure.distances(start[0].unionByName(start[1]), edges, cutoff, MAX_EDGES).groupBy(F.col("source.g").alias("g"))
    away = F.when(F.col("dist") > 0, F.col("dist"))
    lengths = far.agg(F.avg(away).alias("m"), F.median(away).alias("h"), F.count(away).alias("n"))
    parts.append(keyed(lengths, [(("path_length.", name, ".mean"), F.col("m")), (("path_length.", name, ".median"), F.col("h")), (("path_length.", name, ".n_pairs"), F.col("n"))]))
    for kind, rows, columns in (("node", nodes, node_columns), ("edge", edges, edge_columns)):
        if columns:
            gaps = checkpointed(similarity.ks(similarity.long_form(rows, F.col("g"), columns)))
            at = f"{kind}_feature_ks."
            parts.append(keyed(gaps, [((at, "per_dim.ks_stat.", F.col("dim")), F.col("ks")), ((at, "per_dim.ks_pvalue.", F.col("dim")), F.col("p"))]))
            parts.append(keyed(similarity.ks_summary(gaps), [((at, "ks_stat_mean"), F.col("ks_mean")), ((at, "ks_stat_max"), F.col("ks_max")), ((at, "ks_pvalue_mean"), F.col("p_mean"))]))
            fro = similarity.tagged_correlation_distance(rows, F.col("g"), columns)
            parts.append(keyed(fro, [((f"{kind}_feature_corr.corr_fro_norm",), F.col("corr_fro")), ((f"{kind}_feature_corr.dims",), F.lit(len(columns)))]))
    return reduce(DataFrame.unionByName, parts)


def comparison(real: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], *, node_columns: list[str], edge_columns: list[str], sources: int = 2000, seed: int = 7) -> dict:
    """The same as a report: levels of keys as nested objects, figures by feature as lists in the order of the columns, counts as whole numbers."""
    out: dict[str, Any] = {"fraud_patterns": {}}
    for r in compared(real, synthetic, node_columns=node_columns, edge_columns=edge_columns, sources=sources, seed=seed).collect():
        *path, last = r["key"].split(".")
        held = out
        for x in path:
            held = held.setdefault(x, {})
        held[last] = int(r["value"]) if last in ("n_pairs", "dims") else r["value"]
    for kind, columns in (("node_feature_ks", node_columns), ("edge_feature_ks", edge_columns)):
        if columns:
            out[kind]["per_dim"] = {what: [found.get(c) for c in columns] for what, found in out[kind]["per_dim"].items()}
    return sanitised(out)


def evaluated(scores: DataFrame) -> dict[str, dict]:
    """All metrics of rows (split, y, logit) for each split, from one pass; an empty one has NULL metrics and zero counts."""
    found = {r["split"]: r.asDict() for r in metrics.bundles(scores, "split").collect()}
    nothing = dict.fromkeys(metrics.METRICS) | {"n_pos": 0, "n_neg": 0, "f1": 0.0, "f1_best": 0.0}
    return {name: sanitised({k: v for k, v in found.get(name, nothing).items() if k != "split"}) for name in splits.SPLITS}
