"""Small graphs with answers by hand, and quotas with published counts."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.functions import scalars
from tallygraph.functions.scalars import probability
from tallygraph.graph import PropertyGraph, numbered, simple
from tallygraph.operators import features, metrics, sage, sampling, similarity, splits, structure, synth
from tallygraph.plans import distributed, learn, report, roster
from tallygraph.sources import csv
from tallygraph.streaming import running_degrees


def graph(spark, edges, positive=()):
    e = spark.createDataFrame([(k, a, b, int(k in positive)) for k, (a, b) in enumerate(edges)], "eid long, src long, dst long, y int")
    n = spark.createDataFrame(sorted({(v,) for pair in edges for v in pair}), "node long")
    return features.labelled(n, e), e


def one(df):
    return df.collect()[0]


def test_triangle_with_pendant(spark):
    n, e = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    assert one(structure.clustering(n, e))[0] == 0.583333
    r = one(structure.path_lengths(n, e))
    assert (r["path_mean"], r["path_median"], r["n_pairs"]) == (1.333333, 1.0, 12)


def test_structure_queries_count_all_edges(spark, monkeypatch):
    n, e = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    assert one(structure.clustering(n, e, max_edges=2))[0] == 0.0
    late = e.withColumn("eid", F.col("eid") + 1_999_998)  # two edges on either side of the report's limit
    for name in ("trade_edges", "trade_rows", "hop_edges"):
        monkeypatch.setattr(roster, name, lambda s, d: late)
    monkeypatch.setattr(roster, "trade_nodes", lambda s, d: n)
    assert one(roster.QUERIES["q_clustering"](spark, ""))[0] == 0.583333
    assert one(roster.QUERIES["q_path_length"](spark, ""))["n_pairs"] == 12


def test_parallel_edges_and_loops(spark):
    n, e = graph(spark, [(0, 1), (0, 1), (1, 0), (1, 1)])
    assert {r["node"]: (r["in_deg"], r["out_deg"]) for r in structure.degrees(n, e).collect()} == {0: (1, 2), 1: (3, 2)}
    assert simple(e).count() == 1 and one(structure.clustering(n, e))[0] == 0.0
    assert {r["node"]: (r["in_deg"], r["out_deg"]) for r in running_degrees(e).collect()} == {0: (1, 2), 1: (3, 2)}


def test_mean_aggregate(spark):
    n = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 7.0)], "node long, x double")
    e = spark.createDataFrame([(0, 2), (1, 2), (1, 2)], "src long, dst long")
    assert {r[0]: r[1] for r in sage.mean_in(n, e, ["x"]).collect()} == {0: 0.0, 1: 0.0, 2: 3.0}


@pytest.mark.parametrize(("y", "s", "roc", "ap"), [([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1], 0.75, 0.833333), ([1, 0, 1, 0], [0.5, 0.5, 0.5, 0.1], 0.75, 0.666667), ([0, 0], [0.1, 0.2], None, None)])
def test_ranking_metrics(spark, y, s, roc, ap):
    df = spark.createDataFrame(list(zip(y, s, strict=True)), "y int, score double")
    assert one(metrics.roc_auc(df))[0] == roc and one(metrics.average_precision(df))[0] == ap
    assert roc is not None or one(metrics.best_f1(df))[0] == 0.0
    assert ap is None and math.isnan(learn.precision(np.array(y), np.array(s))) or math.isclose(learn.precision(np.array(y), np.array(s)), ap, abs_tol=1e-6)


def test_metrics_of_all_splits_at_once(spark):
    """Each split as by itself: few rows, ties, one class."""
    rng = np.random.default_rng(3)
    rows = [(s, int(rng.random() < 0.4) if s != "d" else 0, float(round(rng.normal(), d))) for s, n, d in (("a", 12, 9), ("b", 50, 1), ("c", 1, 3), ("d", 7, 2)) for _ in range(n)]
    df = spark.createDataFrame(rows, "split string, y int, logit double")
    found = {r["split"]: r.asDict() for r in metrics.bundles(df, "split").collect()}
    assert set(found) == {"a", "b", "c", "d"}
    for split, got in found.items():
        own = df.filter(F.col("split") == split).select("y", probability(F.col("logit")).alias("score"))
        assert (got["roc_auc"], got["pr_auc"], got["f1"], got["f1_best"]) == tuple(one(f(own))[0] for f in (metrics.roc_auc, metrics.average_precision, metrics.f1, metrics.best_f1))
        assert got["n_pos"] + got["n_neg"] == own.count() and got["n_pos"] == own.filter("y = 1").count()
    assert one(metrics.bundle(df.limit(0)))["n_pos"] == 0


def test_ks_and_histograms(spark):
    v = spark.createDataFrame([("a", float(x), 0) for x in (1, 2, 3, 4)] + [("a", float(x), 1) for x in (3, 4, 5, 6)], "dim string, value double, sample int")
    assert one(similarity.ks(v))["ks"] == 0.5
    real, syn = (spark.createDataFrame(x, "deg long, n long") for x in ([(0, 1), (1, 2), (2, 1)], [(0, 2), (1, 1), (3, 1)]))
    assert one(similarity.histogram_l1(real, syn))[0] == 3.0 and one(similarity.histogram_l1(syn, real))[0] is None
    p = spark.range(1).select(similarity.ks_p_value(F.lit(0.003525), F.lit(200000), F.lit(200000)), similarity.ks_p_value(F.lit(0.0), F.lit(9), F.lit(9)), similarity.ks_p_value(F.lit(0.5), F.lit(0), F.lit(9))).first()
    assert math.isclose(p[0], 0.166143476887, abs_tol=1e-5) and p[1:] == (1.0, None)


@pytest.mark.parametrize(("p", "want"), [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (4, (1, 1, 2)), (5, (1, 2, 2)), (586, (195, 195, 196)), (84, (28, 28, 28)), (924, (308, 308, 308))])
def test_even_positives(p, want):
    assert splits.even_positives(p, (10_000, 10_000, 10_000)) == want


@pytest.mark.parametrize(("n", "p", "want"), [(518573, 754, (452, 151, 151)), (200000, 575, (345, 115, 115)), (518573, 31, (19, 6, 6)), (20000, 26, (16, 5, 5))])
def test_stratified_positives(n, p, want):
    assert splits.stratified_positives(n, p) == want


def test_quotas():
    assert splits.split_sizes(518573) == (311143, 103715, 103715) and splits.split_sizes(1637) == (982, 327, 328)
    assert splits.balanced_quota(10, 0.25, 3, 20) == (2, 8) and splits.balanced_quota(10, 0.35, 1, 20) == (1, 9)
    assert splits.truncated_quota(10, 0.35, 1, 20) == (1, 7)
    assert splits.batch_quota(10, 3, 100, 100) == (8, 2) and splits.batch_quota(10, 3, 0, 4) == (0, 4)


def test_split_of_one_class_and_few_rows(spark):
    df = spark.createDataFrame([(k, 0) for k in range(20)], "eid long, y int")
    assert {r["split"]: r["n"] for r in splits.split_counts(splits.split(df, 7)).collect()} == {"train": 12, "val": 4, "test": 4}
    assert [r["split"] for r in splits.split(df.limit(1), 7).collect()] == ["train"] and splits.split(df.limit(0), 7).count() == 0


def test_positive_weight(spark):
    of = lambda y: one(metrics.positive_weight(spark.createDataFrame([(v,) for v in y], "y int")))[0]
    assert of([0, 0]) == 1.0 and of([1] + [0] * 100_000) == 50_000.0


def test_ring_and_rewiring(spark):
    assert synth.augmented(spark, spark.createDataFrame([(0, 0)], "u long, v long"), 900, 4096, 7).count() == 4097
    n, e = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 0), (3, 3)])
    r = synth.rewired(e, 7)
    for c in ("src", "dst"):
        assert sorted(x[c] for x in r.collect()) == sorted(x[c] for x in e.collect())
    assert synth.without_loops(spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 0, 3)], "pos long, src long, dst long")).filter("src = dst").count() == 0


def test_samplers(spark):
    n, e = graph(spark, [(k, k + 1) for k in range(30)] + [(0, 5)], positive=(3,))
    kept, waves = sampling.snowball(n, e, 10, 7)
    assert kept.count() == 10 and sum(r["new_nodes"] for r in waves.collect()) == 10
    assert {r["node"] for r in sampling.k_hop_in(e, spark.createDataFrame([(5,)], "node long"), 2).collect()} == {5, 4, 3, 0}
    assert sampling.enriched(n, e, 12, 7).count() == 12 and sampling.random_induced(n, e, 5, 7).filter("y = 1").count() >= 1
    with pytest.raises(ValueError, match="no edges"):
        sampling.subgraph(e, spark.createDataFrame([(0,), (9,)], "node long"))


def test_scalars(spark):
    df = spark.createDataFrame([("Partnership #12", "2022/09/01 00:20", -5.0), ("Direct", "bad", None), ("A #1 #2", None, 1.0), (None, "x", float("nan"))], "name string, ts string, amt double")
    rows = df.select(scalars.entity_type(F.col("name")).alias("e"), scalars.parsed_time(F.col("ts")).alias("t"), scalars.log_amount(scalars.finite(F.col("amt"))).alias("a")).collect()
    assert [r["e"] for r in rows] == ["Partnership", "Direct", "A #1", "nan"] and [r["t"] is None for r in rows] == [False, True, True, True]
    assert [r["a"] and round(r["a"], 6) for r in rows] == [0.0, None, 0.693147, None]


def test_features(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0), (4, None)], "node long, bank double")
    assert [r["bank"] for r in features.median_filled(df, "bank").orderBy("node").collect()] == [10.0, 20.0, 30.0, 20.0]
    flat = features.scaled(spark.createDataFrame([(1, 2.0), (2, 2.0)], "node long, x double"), {"x": "x"})
    assert [r["x_scaled"] for r in flat.collect()] == [0.0, 0.0]
    assert one(similarity.correlation_distance(flat, flat.withColumn("x_scaled", F.col("node") * 1.0), ["x", "x_scaled"]))[0] == 1.0  # constant columns correlate with nothing, themselves included
    assert [r["k"] for r in numbered(spark.range(5).select(F.col("id")), F.floor(F.col("id") / 2), "id", name="k").orderBy("id").collect()] == list(range(5))


def test_correlation_of_constants_over_tasks(spark):
    """Three tasks' means of 49 equal values merge inexactly, so the deviation of all isn't 0."""
    cut = spark.range(0, 147, 1, 3).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("one"))
    assert one(cut.agg(F.stddev_pop("one")))[0] != 0
    assert one(similarity.correlation_distance(cut, cut.coalesce(1), ["x", "one"]))[0] == 0.0


def test_correlation_of_samples_without_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, z double")
    assert one(similarity.correlation_distance(df, df.limit(0), ["x", "z"]))[0] == one(similarity.correlation_distance(df.limit(0), df, ["x", "z"]))[0] == 2.0
    assert one(similarity.correlation_distance(df.limit(0), df.limit(1), ["x", "z"]))[0] == 0.0


def test_report(tmp_path):
    x = {"a": float("nan"), "b": (np.float64(1.5), np.int64(2)), "c": np.array([1.0, np.inf])}
    assert report.sanitised(x) == {"a": None, "b": [1.5, 2], "c": [1.0, None]}
    report.write_json(str(tmp_path / "deep/x.json"), x)
    assert json.loads((tmp_path / "deep/x.json").read_text())["a"] is None
    assert report.result_name(3, 4, 5, "snowball", edges_only=True, private=True) == "transfer_hi_small_n3_e4_m5_snowball_edgesonly_dp.json"


def test_files(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    (tmp_path / "HI-Small_Trans.csv").write_text(head + "2022/09/01 00:20,010,8000A,3,8000B,1.5,USD,2.5,USD,Cheque,1\nbad,1,X,2,Y,,USD,,USD,,0\n")
    with pytest.raises(FileNotFoundError, match="accounts"):
        csv.resolve_paths(spark, str(tmp_path))
    (tmp_path / "HI-Small_accounts.csv").write_text(" Bank Name ,Bank ID,Account Number,Entity ID,Entity Name\nB,10,8000A,E,Corporation #3\n")
    p = csv.resolve_paths(spark, str(tmp_path))
    rows = csv.read_transactions(spark, p.transactions).orderBy("eid").collect()
    assert [(r["src"], r["dst"], r["amt"], r["fmt"], r["y"]) for r in rows] == [("8000A", "8000B", 2.5, "Cheque", 1), ("X", "Y", None, "nan", 0)]
    assert csv.read_transactions(spark, p.transactions, prefix=1).count() == 1 and rows[1]["ts"] is None
    assert one(csv.read_accounts(spark, p.accounts))["bank"] == 10.0


def test_stored_graph(spark, tmp_path):
    n = spark.createDataFrame([(0, 1, [1.0]), (1, 0, [2.0])], "node long, y int, x array<float>")
    e = spark.createDataFrame([(0, 0, 1, 1)], "eid long, src long, dst long, y int")
    csv.write_graph(PropertyGraph(n, e, {"k": 1}), str(tmp_path / "g"))
    back = csv.read_graph(spark, str(tmp_path / "g"), node_width=3, edge_width=2)
    assert back.meta == {"k": 1} and sorted(r["x"] for r in back.nodes.collect()) == [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0]] and one(back.edges)["edge_attr"] == [0.0, 0.0]
    with pytest.raises(ValueError, match="wider"):
        csv.read_graph(spark, str(tmp_path / "g"), node_width=0, edge_width=2)


def toy(spark):
    rng = np.random.default_rng(0)
    y = [int(k % 3 == 0) for k in range(60)]
    n = spark.createDataFrame([(k, y[k], ("train", "val", "test")[k % 5 % 3], y[k] + 0.1 * float(rng.normal())) for k in range(60)], "node long, y int, split string, x double")
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (200, 2))]
    e = spark.createDataFrame([(k, a, b, y[a], ("train", "val", "test")[k % 5 % 3], 1.0) for k, (a, b) in enumerate(pairs)], "eid long, src long, dst long, y int, split string, w double")
    return PropertyGraph(n, e)


def test_gradients(spark):
    g = learn.Arrays.of(toy(spark), ["x"], ["w"])
    model = learn.Model(1, 1, learn.ModelConfig(hidden=4, emb=3, dropout=0.0))
    rows = np.arange(20)

    def loss(target):
        z = learn.logits(model, g, target)[rows]
        yy = (g.y if target == "node" else g.y_edge)[rows]
        return np.mean(np.log1p(np.exp(-z)) * 2.0 * yy + np.log1p(np.exp(z)) * (1 - yy))

    for target, gradient in (("node", model.node_gradient), ("edge", model.edge_gradient)):
        for name, d in gradient(g, rows, 2.0).items():
            w, at = model.w[name], np.unravel_index(d.size // 2, d.shape)
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss(target)
            w[at] = keep - 1e-5
            down = loss(target)
            w[at] = keep
            assert math.isclose((up - down) / 2e-5, d[at], rel_tol=1e-3, abs_tol=1e-6), (target, name)


def test_transfer(spark, monkeypatch):
    g = toy(spark)
    config = learn.ModelConfig(hidden=8, emb=8, node_epochs=15, edge_epochs=5, syn_node_epochs=15, syn_edge_epochs=5, lr=0.05)
    out = learn.Transfer(config, ["x"], ["w"]).run(g, lambda: g)
    assert out["node"]["real_train_eval"]["test"]["roc_auc"] > 0.9 and set(out["node"]["drop_test"]) == {"roc_auc_drop", "pr_auc_drop", "f1_drop"}
    m = out["edge"]["real_train_eval"]["test"]
    assert math.isclose(m["prevalence"], m["n_pos"] / (m["n_pos"] + m["n_neg"]), abs_tol=1e-6)
    assert out["similarity"]["degree"]["in_deg_hist_l1"] == 0 and {"degree", "clustering_undirected", "path_length", "node_feature_ks", "edge_feature_corr", "label_rates"} <= set(out["similarity"]) and out["fraud_patterns"]["node_degree_by_label"]["syn"]["sar_frac"] > 0 and out["edge"]["synthetic_train_eval"]["val"]["n_pos"] > 0
    monkeypatch.setattr(learn.Transfer, "metrics", lambda *_: {k: dict.fromkeys(("roc_auc", "pr_auc", "f1"), 0.5) for k in splits.SPLITS})
    monkeypatch.setattr(report, "comparison", lambda *_, **__: {})
    only = learn.Transfer(learn.ModelConfig(hidden=4, emb=4, edge_epochs=1, syn_edge_epochs=1, edges_only=True, warm_start=True), ["x"], ["w"]).run(g, lambda: g, least_nodes=60)
    assert only["node"]["skipped"] and only["edge"]["drop_test"]
    with pytest.raises(ValueError, match="fewer than 61"):
        learn.Transfer(learn.ModelConfig(hidden=4, emb=4, node_epochs=1, edge_epochs=1), ["x"], ["w"]).run(g, lambda: g, least_nodes=61)


def test_scores_of_the_default_width(spark):
    g = toy(spark)
    arrays, model = learn.Arrays.of(g, ["x"], ["w"]), learn.Model(1, 1, learn.ModelConfig())
    nodes = {r["node"]: r["logit"] for r in distributed.node_scores(g, model, ["x"]).collect()}
    edges = {r["eid"]: r["logit"] for r in distributed.edge_scores(g, model, ["x"], ["w"]).collect()}
    assert np.allclose([nodes[k] for k in arrays.ids.tolist()], learn.logits(model, arrays, "node"))
    assert np.allclose([edges[k] for k in range(200)], learn.logits(model, arrays, "edge"))


def test_noise_has_the_deviation_that_is_accounted_for():
    rng, config = np.random.default_rng(1), learn.PrivacyConfig(noise=1.5, clip=0.5)
    gradient = {"a": np.full((40, 50), 3.0), "b": np.full(30, -2.0)}
    drawn = np.stack([learn.noised(gradient, config, rng)["a"] for _ in range(60)])
    norm = math.sqrt(40 * 50 * 9 + 30 * 4)
    assert abs(drawn.std() - 0.75) < 0.01 and abs(drawn.mean() - 3 * 0.5 / norm) < 0.02
    small = learn.noised({"a": np.full(4, 0.01)}, learn.PrivacyConfig(noise=0.0), rng)["a"]
    assert np.allclose(small, 0.01)


def test_surroundings_and_last_parallel_edge():
    ids = np.arange(6)
    src, dst = np.array([0, 1, 2, 0, 4, 0]), np.array([1, 2, 3, 1, 5, 3])
    g = learn.Arrays(ids, ids[:, None].astype(float), ids % 2, np.array(["train"] * 6), src, dst, np.arange(6.0)[:, None], np.zeros(6), np.array(["train"] * 6))
    near, place = g.around(np.array([2]), 2)
    assert near.ids.tolist() == [0, 1, 2] and place.tolist() == [0, 1, 2, -1, -1, -1]
    assert list(zip(near.src.tolist(), near.dst.tolist(), strict=True)) == [(0, 1), (1, 2), (0, 1)] and near.attr.ravel().tolist() == [0.0, 1.0, 3.0]
    assert near.columns_of(np.array([0, 1, 2]), np.array([1, 2, 0])).tolist() == [2, 1, -1]
    assert g.around(np.array([3]), 1)[0].ids.tolist() == [0, 2, 3]


def test_private_training_and_stored_weights(spark, tmp_path):
    """A run replaces the one before it as a whole, once it is complete."""
    arrays, config = learn.Arrays.of(toy(spark), ["x"], ["w"]), learn.ModelConfig(hidden=8, emb=8)
    for target in ("node", "edge"):
        store = learn.Store(spark, str(tmp_path), target)
        for epochs in (3, 2):
            model, meta = learn.trained_privately(learn.Model(1, 1, config), arrays, target, epochs, learn.PrivacyConfig(steps=3, batch=8, hops=1), store)
        assert meta["total_optimizer_steps"] == 6 and meta["epsilon_rdp"] > 0
        assert store.names(f"{tmp_path}/{target}") == ["best.npz", "epoch_0001.npz", "epoch_0002.npz"] and not (tmp_path / f"{target}.next").exists()
        back = store.load("best", learn.Model(1, 1, config))
        assert np.allclose(learn.logits(back, arrays, target), learn.logits(model, arrays, target))
        with pytest.raises(ValueError, match="another model"):
            store.load("best", learn.Model(2, 1, config))
        with pytest.raises(FileNotFoundError):
            store.load("epoch_0003", learn.Model(1, 1, config))
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["edge", "node"]


def test_interrupted_training_goes_on(spark, tmp_path, monkeypatch):
    """A driver lost in the third epoch: the run before stays in place, and the next one ends at the weights of an undisturbed one."""
    arrays, config, privacy = learn.Arrays.of(toy(spark), ["x"], ["w"]), learn.ModelConfig(hidden=8, emb=8, dropout=0.0), learn.PrivacyConfig(steps=2, batch=8, hops=1)
    run = lambda store, epochs=4: learn.trained_privately(learn.Model(1, 1, config), arrays, "node", epochs, privacy, store)
    whole = learn.Store(spark, str(tmp_path), "whole")
    want, _ = run(whole)
    store = learn.Store(spark, str(tmp_path), "node")
    run(store, 1)
    write = learn.Store.write

    def lost(self, path, data):
        if path.endswith("epoch_0003.npz"):
            part, files = self.at(f"{path}.part")
            out = files.create(part)
            out.write(bytearray(data[:100]))
            out.close()
            raise ConnectionError("driver lost")
        write(self, path, data)

    monkeypatch.setattr(learn.Store, "write", lost)
    with pytest.raises(ConnectionError):
        run(store)
    assert store.names(f"{tmp_path}/node") == ["best.npz", "epoch_0001.npz"] and "epoch_0003.npz" not in store.names(store.running)
    monkeypatch.setattr(learn.Store, "write", write)
    found, meta = run(store)
    assert meta["total_optimizer_steps"] == 8 and all(np.array_equal(found.w[k], want.w[k]) for k in want.w)
    last = [x.load("epoch_0004", learn.Model(1, 1, config)) for x in (store, whole)]
    assert all(np.array_equal(last[0].w[k], last[1].w[k]) for k in want.w) and len(store.names(f"{tmp_path}/node")) == 5


def test_accounting():
    rate = 8 / 40
    assert learn.epsilon(learn.PrivacyConfig(noise=1.0), rate, 6) < learn.epsilon(learn.PrivacyConfig(noise=1.0), rate, 60) and learn.epsilon(learn.PrivacyConfig(noise=0.0), rate, 6) is None


def test_batch_quota():
    assert [splits.batch_quota(8, r, 50, 50) for r in (0.1, 1, 3)] == [(4, 4), (4, 4), (6, 2)]
    assert splits.batch_quota(8, 3, 2, 50) == (2, 6) and splits.batch_quota(8, 1, 50, 1) == (7, 1) and splits.batch_quota(8, 1, 0, 5) == (0, 5)


def test_exact_quantiles(spark):
    rng = random.Random(2)
    for values in ([3.0], [1.0, 2.0], [5.0] * 7 + [1e300], [rng.choice([rng.random(), 1.0, -4.0]) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert np.allclose(metrics.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]), np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert metrics.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_first_beyond_the_ordered_limit(spark, monkeypatch):
    import tallygraph.graph as graph

    monkeypatch.setattr(graph, "TOP", 5)
    assert sorted(r[0] for r in graph.first(spark.range(100), 30, F.col("id").desc()).collect()) == list(range(70, 100))
    assert graph.first(spark.range(100), 0, "id").count() == 0


def test_no_edge_cap_bites(spark):
    """Queries count all edges, more than a cap of the report would."""
    e = spark.range(2000).select(F.col("id").alias("eid"), (F.col("id") % 50).alias("src"), (F.col("id") * 7 % 53).alias("dst"), F.lit(0).alias("y"))
    n = spark.range(53).select(F.col("id").alias("node"), F.lit(0).alias("y"))
    assert one(structure.clustering(n, e)) != one(structure.clustering(n, e, max_edges=300))
    assert one(structure.path_lengths(n, e, sources=5, cutoff=1))["n_pairs"] > one(structure.path_lengths(n, e, sources=5, cutoff=1, max_edges=30))["n_pairs"]


def test_streaming_degrees(spark, tmp_path):
    """Edges that arrive in two files, in complete mode."""
    spark.createDataFrame([(0, 1), (0, 1)], "src long, dst long").write.parquet(str(tmp_path / "edges"))
    stream = running_degrees(spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "edges")))
    run = stream.writeStream.format("memory").queryName("degrees").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        run.processAllAvailable()
        spark.createDataFrame([(1, 1), (2, 0)], "src long, dst long").write.mode("append").parquet(str(tmp_path / "edges"))
        run.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("degrees").collect()) == [(0, 1, 2), (1, 3, 1), (2, 0, 1)]
    finally:
        run.stop()
