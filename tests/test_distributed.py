"""Gradients and training on the cluster against NumPy on one array."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.graph import Adjacency, PropertyGraph
from tallygraph.operators.vectors import vector_sums
from tallygraph.plans import distributed, learn


def toy(spark, nodes=40, edges=150):
    rng = np.random.default_rng(0)
    y = [int(k % 3 == 0) for k in range(nodes)]
    split = lambda k: ("train", "val", "test")[k % 5 % 3]
    n = spark.createDataFrame([(k, y[k], split(k), y[k] + 0.1 * float(rng.normal()), float(rng.normal())) for k in range(nodes)], "node long, y int, split string, x double, z double")
    pairs = [(int(a) if k % 4 else 1, int(b) if k % 5 else 2) for k, (a, b) in enumerate(rng.integers(0, nodes, (edges, 2)))]
    e = spark.createDataFrame([(k, a, b, y[a], split(k), float(rng.normal())) for k, (a, b) in enumerate(pairs)], "eid long, src long, dst long, y int, split string, w double")
    return PropertyGraph(n, e)


@pytest.fixture(scope="module")
def graph(spark):
    return toy(spark)


NAMES = (["x", "z"], ["w"])


def same(a, b):
    assert set(a) == set(b)
    for name in a:
        assert np.allclose(a[name], b[name], rtol=1e-9, atol=1e-12), name


@pytest.mark.parametrize(("target", "layers", "hub"), [("node", 2, 10**6), ("edge", 2, 4), ("edge", 3, 10**6)])
def test_gradient_equals_numpy(spark, graph, target, layers, hub, monkeypatch):
    """With hubs in blocks of 4 as without any."""
    monkeypatch.setattr(Adjacency.of.__func__, "__kwdefaults__", {"distinct": True, "hub": hub})
    arrays, model = learn.Arrays.of(graph, *NAMES), learn.Model(2, 1, learn.ModelConfig(hidden=5, emb=3, layers=layers, dropout=0.0))
    g = distributed.LaidOut.of(graph, *NAMES)
    assert (g.outgoing.hubs is None) == (hub > 4)
    _, rows, _ = learn.parts(arrays, target)
    wanted, _ = distributed.training_rows(g, target)
    want = (model.node_gradient if target == "node" else model.edge_gradient)(arrays, rows, 2.5)
    same(distributed.gradient(g, model, target, wanted, 2.5), want)


def test_training_equals_numpy(spark, graph):
    """Two epochs without dropout end at the same weights, and scores are those of the model."""
    config = learn.ModelConfig(hidden=4, emb=3, dropout=0.0, lr=0.01)
    arrays, g = learn.Arrays.of(graph, *NAMES), distributed.LaidOut.of(graph, *NAMES)
    a = learn.trained(learn.Model(2, 1, config), arrays, "edge", 2)
    b = distributed.trained(learn.Model(2, 1, config), g, "edge", 2)
    for name in a.w:
        assert np.allclose(a.w[name], b.w[name], atol=1e-8), name
    _, _, val = learn.parts(arrays, "edge")
    found = sorted(r["logit"] for r in distributed.scores(g, b, "edge", "val").collect())
    assert np.allclose(found, sorted(learn.logits(a, arrays, "edge")[val]), atol=1e-6)


@pytest.mark.parametrize("target", ["node", "edge"])
def test_private_steps_see_their_surroundings(spark, graph, target):
    """Without noise and clipping a step is the gradient of the batch in its surroundings, found by plain search."""
    config = learn.ModelConfig(hidden=4, emb=3, dropout=0.0)
    g, arrays = distributed.LaidOut.of(graph, *NAMES), learn.Arrays.of(graph, *NAMES)
    privacy = learn.PrivacyConfig(noise=0.0, clip=1e9, batch=6, steps=1, hops=1)
    moved, meta = distributed.trained_privately(learn.Model(2, 1, config), g, target, 1, privacy)
    rows, weight = distributed.training_rows(g, target)
    key = "node" if target == "node" else "eid"
    drawn = distributed.batches.minibatches(rows.withColumnRenamed("label", "y"), 1, 6, 1, config.seed, key=key).collect()
    batch, plain = np.array([r[key] for r in drawn]), learn.Model(2, 1, config)
    if target == "node":
        near, place = arrays.around(batch, 1)
        d = plain.node_gradient(near, place[batch], weight)
    else:
        near, place = arrays.around(np.unique(np.concatenate([arrays.src[batch], arrays.dst[batch]])), 1)
        d = plain.edge_gradient(near, near.columns_of(place[arrays.src[batch]], place[arrays.dst[batch]]), weight, arrays.y_edge[batch])
    plain.adam(d)
    for name in plain.w:
        assert np.allclose(plain.w[name], moved.w[name], atol=1e-7), name
    assert meta["total_optimizer_steps"] == 1


def test_experiment_on_a_graph_beyond_one_process(spark, graph, monkeypatch):
    """Graphs over the bound are trained on the cluster, with the same report."""
    from tallygraph.plans import report
    from tallygraph.operators import splits

    monkeypatch.setattr(learn, "MAX_EDGES", 100)
    monkeypatch.setattr(learn.Transfer, "metrics", lambda *_: {k: dict.fromkeys(("roc_auc", "pr_auc", "f1"), 0.5) for k in splits.SPLITS})
    monkeypatch.setattr(report, "comparison", lambda *_, **__: {})
    with pytest.raises(ValueError, match="at most 100"):
        learn.Arrays.of(graph, *NAMES)
    config = learn.ModelConfig(hidden=4, emb=3, edge_epochs=1, syn_edge_epochs=1, edges_only=True)
    out = learn.Transfer(config, *NAMES).run(graph, lambda: graph)
    assert out["edge"]["drop_test"] == {"roc_auc_drop": 0.0, "pr_auc_drop": 0.0, "f1_drop": 0.0}


def test_dropout_is_decided_by_the_row():
    seeds = np.arange(2000) * 7919
    a = distributed.dropped(seeds, 50, 0.25)
    assert set(np.unique(a)) == {0.0, 1 / 0.75} and abs((a == 0).mean() - 0.25) < 0.01 and (a == distributed.dropped(seeds, 50, 0.25)).all()
    assert abs(np.corrcoef(a[:, 0], a[:, 1])[0, 1]) < 0.1


def test_vector_sums(spark):
    """A key with a third of all rows, string keys, nulls, one row and none."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    odd = rows.unionByName(spark.createDataFrame([(None, [1.0, 1.0]), ("x", None), ("one", [2.0, 3.0])], "key string, v array<double>"))
    found = {r["key"]: r["v"] for r in vector_sums(odd, "key", "v", 2).collect()}
    want = {r["key"]: [r["a"], float(r["n"])] for r in rows.groupBy("key").agg(F.sum(F.col("v")[0]).alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    assert found == want | {"one": [2.0, 3.0]}
    assert vector_sums(rows.limit(0), "key", "v", 2).count() == 0
