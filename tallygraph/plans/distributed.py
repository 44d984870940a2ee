"""Training of the GraphSAGE classifiers on graphs of any size: exact gradients as Spark joins, vector sums and matrix products by partition.

A layer sends each node's vector along its edges (lists in blocks, so hubs are many tasks' work), adds up what arrives and
multiplies by the weights, which every task holds. The way back sends gradients along the same edges the other way. Gradients
of weights are added up within tasks and then over tasks; only their sums, as large as the model, reach the driver, which
takes the optimiser's step. Every layer is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..graph import Adjacency, PropertyGraph, checkpointed
from ..operators import batches, metrics
from ..operators.vectors import lists, matrix, vector_sums
from .learn import Best, Model, PrivacyConfig, Store, accounted, loss_gradient, noised


def vector(columns: list[str]) -> Column:
    """The columns as one vector, missing values as 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns]) if columns else F.array().cast("array<double>")


@dataclass(frozen=True)
class LaidOut:
    """nodes(node, y, split, many, h) with the number of incoming edges and the features; edges(eid, src, dst, y, split, attr); lists by source and by destination."""

    nodes: DataFrame
    edges: DataFrame
    outgoing: Adjacency
    into: Adjacency
    widths: tuple[int, int]

    @classmethod
    def of(cls, graph: PropertyGraph, node_columns: list[str], edge_columns: list[str]) -> LaidOut:
        edges = checkpointed(graph.edges.select("eid", "src", "dst", "y", "split", vector(edge_columns).alias("attr")))
        nodes = graph.nodes.select("node", "y", "split", vector(node_columns).alias("h"))
        return cls.wired(nodes, edges, (len(node_columns), len(edge_columns)))

    @classmethod
    def wired(cls, nodes: DataFrame, edges: DataFrame, widths: tuple[int, int]) -> LaidOut:
        many = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("many"))
        held = nodes.join(many, "node", "left").withColumn("many", F.coalesce("many", F.lit(0)))
        outgoing = Adjacency.of(edges.select(F.col("src").alias("at"), F.col("dst").alias("node"), "eid"), distinct=False)
        into = Adjacency.of(edges.select(F.col("dst").alias("at"), F.col("src").alias("node"), "eid"), distinct=False)
        return cls(checkpointed(held), edges, outgoing, into, widths)


def sent(lists_: Adjacency, rows: DataFrame, value: str, width: int) -> DataFrame:
    """node and value: the sum of the vectors that reach each node along the lists from rows(node, value)."""
    return vector_sums(lists_.met(rows.select(F.col("node").alias("at"), value)).select("node", value), "node", value, width)


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width) if width else F.array().cast("array<double>")


def dropped(seeds: np.ndarray, width: int, rate: float) -> np.ndarray:
    """Factors of a random dropout that a row's seed decides: 0 at that rate, else the inverse of the rest."""
    place = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = seeds.astype(np.int64).view(np.uint64)[:, None] ^ place
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)) * 2.0**-53 >= rate) / (1 - rate)


def encoded(g: LaidOut, model: Model, dropout: str | None = None) -> list[DataFrame]:
    """A table of each layer: node, many, h (what it took), mean (of what arrived) and out. dropout: a salt, in training."""
    w, rate, layers, out = model.w, model.config.dropout if dropout else 0.0, model.config.layers, []
    h, width = g.nodes.select("node", "many", "h"), g.widths[0]
    kind = g.nodes.schema["node"].dataType
    for k in range(layers):
        own = {n: w[f"{n}{k}"] for n in ("mean", "self", "bias")}
        last = k == layers - 1

        def layer(parts: Iterator[pa.RecordBatch], own: dict = own, width: int = width, last: bool = last) -> Iterator[pa.RecordBatch]:
            for b in parts:
                many, take = b.column(1).to_numpy(zero_copy_only=False), matrix(b.column(2), width)
                mean = matrix(b.column(3), width) / np.maximum(many, 1)[:, None]
                z = mean @ own["mean"] + own["bias"] + take @ own["self"]
                if not last:
                    z = np.maximum(z, 0)
                    if rate:
                        z *= dropped(b.column(4).to_numpy(zero_copy_only=False), z.shape[1], rate)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(to_arrow_type(kind)), pa.array(many, pa.int64()), lists(take), lists(mean), lists(z)], names=["node", "many", "h", "mean", "out"])

        arrived = sent(g.outgoing, h, "h", width).withColumnRenamed("h", "total")
        joined = h.join(arrived, "node", "left").select("node", "many", "h", F.coalesce("total", zeros(width)).alias("total"), F.xxhash64("node", F.lit(f"{dropout}:{k}")).alias("seed"))
        out.append(checkpointed(joined.mapInArrow(layer, f"node {kind.simpleString()}, many long, h array<double>, mean array<double>, out array<double>")))
        h, width = out[-1].select("node", "many", F.col("out").alias("h")), w[f"mean{k}"].shape[1]
    return out


PARTIAL = ["name", "place", "node", "a", "b"]


def partial_rows(kind: pa.DataType, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A task's sums as rows: a row of a matrix for each name and place."""
    flat = [(n, i, row) for n, m in sums.items() for i, row in enumerate(np.atleast_2d(m))]
    values = pa.array([r.tolist() for _, _, r in flat], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in flat], pa.string()), pa.array([i for _, i, _ in flat], pa.int32()), pa.nulls(len(flat), kind), values, pa.nulls(len(flat), pa.list_(pa.float64()))], names=PARTIAL)


def node_rows(kind: pa.DataType, nodes: pa.Array, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    none = lambda t: pa.nulls(len(nodes), t)
    return pa.RecordBatch.from_arrays([none(pa.string()), none(pa.int32()), nodes.cast(kind), lists(a), none(pa.list_(pa.float64())) if b is None else lists(b)], names=PARTIAL)


def passed(rows: DataFrame, kind, work: Callable[[pa.RecordBatch], tuple[dict[str, np.ndarray], list]]) -> DataFrame:
    """name, place, node, a, b: node rows that work yields for each batch, and each task's sums of the matrices it yields besides."""
    arrow = to_arrow_type(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in parts:
            sums, rows_ = work(b)
            for n, m in sums.items():
                total[n] = total[n] + m if n in total else m
            yield from (node_rows(arrow, *r) for r in rows_)
        if total:
            yield partial_rows(arrow, total)

    return checkpointed(rows.mapInArrow(run, f"name string, place int, node {kind.simpleString()}, a array<double>, b array<double>"))


def gradient(g: LaidOut, model: Model, target: str, wanted: DataFrame, weight: float, *, dropout: str | None = None) -> dict[str, np.ndarray]:
    """The gradient of the mean weighted cross-entropy over wanted: (node, label), or (eid, label) with an edge for each row."""
    kind, w, config = g.nodes.schema["node"].dataType, model.w, model.config
    n = wanted.count()
    layers = encoded(g, model, dropout)
    rate, emb = config.dropout if dropout else 0.0, config.emb
    top = layers[-1].select("node", F.col("out").alias("h"))
    if target == "node":

        def head(b: pa.RecordBatch) -> tuple[dict, list]:
            h, y = matrix(b.column(1), emb), b.column(2).to_numpy(zero_copy_only=False)
            d = (loss_gradient((h @ w["node"] + w["node_bias"]).ravel(), y, weight) * len(y) / n)[:, None]
            return {"node": h.T @ d, "node_bias": d.sum(0)}, [(b.column(0), d @ w["node"].T)]

        start = passed(top.join(wanted.select("node", "label"), "node").select("node", "h", F.col("label").cast("double")), kind, head)
    else:
        edge_width = g.widths[1]

        def head(b: pa.RecordBatch) -> tuple[dict, list]:
            ends, y = [matrix(b.column(c), emb) for c in (2, 3)], b.column(5).to_numpy(zero_copy_only=False)
            x, masks, held = np.concatenate([*ends, matrix(b.column(4), edge_width)], 1), [], []
            for k in (1, 2):
                z = np.maximum((held[-1] if held else x) @ w[f"edge{k}"] + w[f"edge{k}_bias"], 0)
                mask = (z > 0).astype(float)
                if rate:
                    mask *= dropped(b.column(6).to_numpy(zero_copy_only=False) + k, z.shape[1], rate)
                held.append(np.where(mask > 0, z * mask, 0))
                masks.append(mask)
            d = (loss_gradient((held[1] @ w["edge3"] + w["edge3_bias"]).ravel(), y, weight) * len(y) / n)[:, None]
            second = d @ w["edge3"].T * masks[1]
            first = second @ w["edge2"].T * masks[0]
            dx = first @ w["edge1"].T
            sums = {"edge3": held[1].T @ d, "edge3_bias": d.sum(0), "edge2": held[0].T @ second, "edge2_bias": second.sum(0), "edge1": x.T @ first, "edge1_bias": first.sum(0)}
            return sums, [(b.column(0), dx[:, :emb]), (b.column(1), dx[:, emb : 2 * emb])]

        ends = gathered(g, top, wanted)
        seed = F.xxhash64("eid", F.lit(f"{dropout}:edge"))
        start = passed(ends.select("src", "dst", "a", "b", "attr", F.col("label").cast("double"), seed), kind, head)
    tables = [start]
    dh = vector_sums(start.filter("name IS NULL").select("node", F.col("a").alias("d")), "node", "d", emb)
    for k in reversed(range(config.layers)):
        took, gave = w[f"mean{k}"].shape
        last = k == config.layers - 1

        def back(b: pa.RecordBatch, k: int = k, took: int = took, gave: int = gave, last: bool = last) -> tuple[dict, list]:
            many, h, mean, out, d = b.column(1).to_numpy(zero_copy_only=False), *(matrix(b.column(c), v) for c, v in ((2, took), (3, took), (4, gave), (5, gave)))
            dz = d if last else d * (out > 0) / (1 - rate)
            sums = {f"mean{k}": mean.T @ dz, f"bias{k}": dz.sum(0), f"self{k}": h.T @ dz}
            return sums, [(b.column(0), dz @ w[f"self{k}"].T, dz @ w[f"mean{k}"].T / np.maximum(many, 1)[:, None])] if k else []

        held = layers[k].join(dh, "node").select("node", "many", "h", "mean", "out", "d")
        tables.append(passed(held, kind, back))
        if k:
            own = tables[-1].filter("name IS NULL")
            heard = sent(g.into, own.select("node", F.col("b").alias("d")), "d", took)
            dh = vector_sums(own.select("node", F.col("a").alias("d")).unionByName(heard), "node", "d", took)
    return collected([t.filter("name IS NOT NULL").select("name", "place", "a") for t in tables], w, target)


def gathered(g: LaidOut, h: DataFrame, wanted: DataFrame) -> DataFrame:
    """eid, src, dst, a and b (both ends' vectors), attr, label of the edges wanted; edges of a hub are dealt to its blocks."""
    rows = g.edges.select("eid", "src", "dst", "attr").join(wanted.select("eid", "label"), "eid")
    at = h.select(F.col("node").alias("at"), "h")
    one = g.outgoing.given(rows.withColumn("at", F.col("src")), at, "eid").withColumnRenamed("h", "a").drop("at")
    return g.into.given(one.withColumn("at", F.col("dst")), at, "eid").withColumnRenamed("h", "b").drop("at")


def collected(parts: list[DataFrame], w: dict[str, np.ndarray], target: str) -> dict[str, np.ndarray]:
    """Sums over tasks, matrices put together; what no row reached is 0. The driver gets as many numbers as the model has."""
    rows: dict[tuple[str, int], list[float]] = {}
    by_width: dict[int, list[DataFrame]] = {}
    for p in parts:
        for width in {m.shape[-1] for m in w.values()}:
            by_width.setdefault(width, []).append(p.filter(F.size("a") == width))
    for width, own in by_width.items():
        keyed = reduce(DataFrame.unionByName, own).select(F.concat_ws(":", "name", "place").alias("key"), F.col("a").alias("v"))
        for r in vector_sums(keyed, "key", "v", width).collect():
            name, place = r["key"].split(":")
            rows[name, int(place)] = r["v"]
    used = [n for n in w if n.startswith(("mean", "self", "bias", target))]
    flat = {n: [rows.get((n, i), [0.0] * w[n].shape[-1]) for i in range(np.atleast_2d(w[n]).shape[0])] for n in used}
    return {n: np.array(v).reshape(w[n].shape) for n, v in flat.items()}


def logits(g: LaidOut, model: Model, target: str, rows: DataFrame | None = None) -> DataFrame:
    """node or eid, and logit, of all of them or of rows(node) or rows(eid)."""
    top, emb, w, key = encoded(g, model)[-1].select("node", F.col("out").alias("h")), model.config.emb, model.w, "node" if target == "node" else "eid"
    table = g.nodes if target == "node" else g.edges
    rows = table.select(key) if rows is None else rows.select(key)
    if target == "node":
        held = top.join(rows, "node").select("node", F.col("h").alias("a"))
    else:
        held = gathered(g, top, rows.withColumn("label", F.lit(None).cast("int"))).select("eid", "a", "b", "attr")
    edge_width, kind = g.widths[1], table.schema[key].dataType

    def head(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if target == "node":
                logit = matrix(b.column(1), emb) @ w["node"] + w["node_bias"]
            else:
                logit = np.concatenate([matrix(b.column(1), emb), matrix(b.column(2), emb), matrix(b.column(3), edge_width)], 1)
                for k in (1, 2, 3):
                    logit = logit @ w[f"edge{k}"] + w[f"edge{k}_bias"]
                    logit = np.maximum(logit, 0) if k < 3 else logit
            yield pa.RecordBatch.from_arrays([b.column(0).cast(to_arrow_type(kind)), pa.array(logit.ravel())], names=[key, "logit"])

    return held.mapInArrow(head, f"{key} {kind.simpleString()}, logit double")


def scores(g: LaidOut, model: Model, target: str, split: str) -> DataFrame:
    """y and logit of a split's nodes or edges."""
    table, key = (g.nodes, "node") if target == "node" else (g.edges, "eid")
    own = table.filter(F.col("split") == split).select(key, "y")
    return own.join(logits(g, model, target, own), key).select("y", "logit")


def node_scores(graph: PropertyGraph, model: Model, node_columns: list[str]) -> DataFrame:
    """node, y, split, logit of every node."""
    return graph.nodes.select("node", "y", "split").join(logits(LaidOut.of(graph, node_columns, []), model, "node"), "node")


def edge_scores(graph: PropertyGraph, model: Model, node_columns: list[str], edge_columns: list[str]) -> DataFrame:
    """eid, y, split, logit of every edge: both ends' vectors meet at the edge."""
    return graph.edges.select("eid", "y", "split").join(logits(LaidOut.of(graph, node_columns, edge_columns), model, "edge"), "eid")


class Kept(Best):
    """The same of a graph laid out on the cluster."""

    def __init__(self, model: Model, g: LaidOut, target: str, store: Store | None = None) -> None:
        self.model, self.g, self.target, self.store, self.score, self.kept = model, g, target, store, -np.inf, None

    def judged(self, model: Model) -> float:
        found = metrics.average_precision(scores(self.g, model, self.target, "val").select("y", F.col("logit").alias("score"))).collect()[0][0]
        return np.nan if found is None else found


def training_rows(g: LaidOut, target: str) -> tuple[DataFrame, float]:
    """Rows of the training split with their label, and the weight of positives."""
    table, key = (g.nodes, "node") if target == "node" else (g.edges, "eid")
    rows = table.filter("split = 'train'").select(key, F.col("y").alias("label"))
    return rows, metrics.positive_weight(rows.select(F.col("label").alias("y"))).collect()[0][0]


def trained(model: Model, g: LaidOut, target: str, epochs: int) -> Model:
    """Full-batch epochs."""
    rows, weight = training_rows(g, target)
    kept = Kept(model, g, target)
    for epoch in range(1, epochs + 1 if rows.limit(1).count() else 1):
        model.adam(gradient(g, model, target, rows, weight, dropout=f"{model.config.seed}:{target}:{epoch}"))
        kept.after(epoch)
    return kept.restore()


def step_graph(g: LaidOut, nodes: DataFrame, edges: DataFrame) -> LaidOut:
    """The subgraph of nodes(node) and edges(eid), of one step's surroundings."""
    own = checkpointed(g.edges.join(edges.select("eid"), "eid", "left_semi"))
    return LaidOut.wired(g.nodes.drop("many").join(nodes.select("node"), "node", "left_semi"), own, g.widths)


def trained_privately(model: Model, g: LaidOut, target: str, epochs: int, config: PrivacyConfig, store: Store | None = None) -> tuple[Model, dict]:
    """Steps on the surroundings of balanced batches, clipped and noised; an epoch's batches and surroundings are one plan. Returns the accounting too."""
    rows, weight = training_rows(g, target)
    kept = Kept(model, g, target, store)
    key = "node" if target == "node" else "eid"
    pool, n = rows.withColumnRenamed("label", "y"), rows.count()
    near = batches.incoming_lists(g.edges)
    done = kept.resumed()
    steps = done * config.steps
    for epoch in range(done + 1, epochs + 1 if n else 1):
        first, rng = (epoch - 1) * config.steps, np.random.default_rng([model.config.seed + (target == "edge"), epoch])
        drawn = checkpointed(batches.minibatches(pool, config.steps, config.batch, config.ratio, model.config.seed, key=key, first=first))
        ends = drawn.select("step", "node") if target == "node" else batches.batch_endpoints(batches.batch_edges(drawn, g.edges))
        nodes = checkpointed(batches.surroundings(near, ends, config.hops))
        around = checkpointed(batches.surrounding_edges(near, nodes))
        labels = drawn.select("step", key, F.col("y").alias("label"))
        if target == "edge":
            seen = batches.local_edges(batches.batch_edges(drawn, g.edges), around)
            labels = labels.join(seen, ["step", "eid"]).select("step", F.col("seen").alias("eid"), "label")
        labels = checkpointed(labels)
        for step in range(first, first + config.steps):
            own = lambda df, step=step: df.filter(F.col("step") == step)
            small = step_graph(g, own(nodes), own(around))
            model.adam(noised(gradient(small, model, target, own(labels), weight, dropout=f"{model.config.seed}:{target}:{step}"), config, rng))
            steps += 1
        kept.after(epoch)
    return kept.restore(), accounted(config, target, epochs, steps, n, store)
