"""Files to graph, subgraphs, synthetic graphs and the sampler table, on a small generated file."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.operators import structure
from tallygraph.plans import build, learn, report
from tallygraph.sources import csv


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("files"), random.Random(1)
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    rows = [f"2022/09/0{rng.randrange(1, 9)} 00:20,{rng.randrange(9)},A{rng.randrange(80):03d},{rng.randrange(9)},A{rng.randrange(80):03d},1,USD,{rng.randrange(1, 900)},USD,{rng.choice(['Cheque', 'Wire'])},{int(k % 25 == 0)}" for k in range(600)]
    (at / "HI-Small_Trans.csv").write_text(head + "\n".join(rows) + "\n")
    (at / "HI-Small_accounts.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n" + "".join(f"B,{k % 7},A{k:03d},E,{('Direct', 'Partnership')[k % 2]} #{k}\n" for k in range(0, 70)))
    return str(at)


@pytest.fixture(scope="module")
def graph(spark, folder):
    return build.load_graph(spark, folder, add_degree_features=True)


def test_load(graph):
    m = graph.meta
    assert m["n_edges"] == 600 and m["edge_rate"] == 0.04 and {"Unknown"} <= {r[0] for r in graph.nodes.select("entity_type").distinct().collect()}
    assert m["node_width"] == len(m["node_columns"]) == 6 and m["edge_width"] == 6
    assert {k: v["n"] for k, v in m["edge_splits"].items()} == {"train": 360, "val": 120, "test": 120}
    mean = graph.edges.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("amt_scaled", "from_bank_scaled")]).collect()[0]
    assert [abs(x) for x in mean] == [0.0, 0.0]


def test_balanced_slice_of_files(spark, folder):
    g = build.load_graph(spark, folder, max_transactions=100, slice_mode="balanced", target_edge_pos_fraction=0.2)
    assert g.edges.count() == 100 and g.edges.filter("y = 1").count() == 20
    with pytest.raises(ValueError, match="slice_mode"):
        build.load_graph(spark, folder, slice_mode="other")
    for rows in (None, 0):
        with pytest.raises(ValueError, match="positive max_transactions"):
            build.load_graph(spark, folder, max_transactions=rows, slice_mode="balanced_edges")


def test_lenient_scan(spark, tmp_path, monkeypatch):
    """Rows with too few columns count toward the window but are left out; blanks are 0."""
    monkeypatch.setattr(csv, "FLOOR", 1)
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    lines = ["t,1,A,2,B,1,USD,5,USD,Wire,1", "t,1,short", "t,1,C,2,D,1,USD,,USD,Wire,", "t,1,E,2,F,1,USD,7,USD,Wire,0", "t,1,G,2,H,1,USD,8,USD,Wire,1"]
    (tmp_path / "x.csv").write_text(head + "\n".join(lines) + "\n")
    rows = csv.read_transactions(spark, str(tmp_path / "x.csv"), window=4, lenient=True).orderBy("eid").collect()
    assert [(r["eid"], r["src"], r["amt"], r["y"]) for r in rows] == [(0, "A", 5.0, 1), (2, "C", 0.0, 0), (3, "E", 7.0, 0)]
    g = build.load_scanned(spark, str(tmp_path / "x.csv"), max_transactions=4, balance_scan_rows=10, target_edge_pos_fraction=0.5)
    assert [(r["node"], r["account_id"], r["y"]) for r in g.nodes.orderBy("node").collect()] == [(0, "A", 1), (1, "B", 1), (2, "C", 0), (3, "D", 0), (4, "E", 0), (5, "F", 0), (6, "G", 1), (7, "H", 1)]


def test_files_in_order_of_their_names(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    (tmp_path / "many").mkdir()
    for k, n in enumerate((3, 400, 20)):
        (tmp_path / "many" / f"part{k}.csv").write_text(head + "".join(f"t,1,f{k}r{j},2,B,1,USD,5,USD,Wire,0\n" for j in range(n)))
    want = [f"f{k}r{j}" for k, n in enumerate((3, 400, 20)) for j in range(n)]
    at = lambda **x: [r["src"] for r in csv.read_transactions(spark, str(tmp_path / "many"), **x).orderBy("eid").collect()]
    assert at() == want and at(prefix=5) == want[:5] and at(prefix=410) == want[:410] and at(prefix=10_000) == want


@pytest.mark.parametrize("mode", build.SAMPLING)
def test_samples(graph, mode):
    g = build.sampled(graph, mode, 30, 7)
    assert sorted(r["node"] for r in g.nodes.select("node").collect()) == list(range(g.nodes.count()))
    assert g.edges.join(g.nodes.select(F.col("node").alias("src")), "src", "left_anti").count() == 0 and g.nodes.filter("y = 1").count() >= 1


def test_degree_preserving(graph):
    g = build.degree_preserving(graph, 7)
    both = [sorted((r["node"], r["in_deg"], r["out_deg"]) for r in structure.degrees(x.nodes, x.edges).collect()) for x in (graph, g)]
    assert both[0] == both[1]
    out = report.comparison((graph.nodes, graph.edges), (g.nodes, g.edges), node_columns=graph.meta["node_columns"], edge_columns=graph.meta["edge_columns"], sources=5)
    assert out["degree"]["in_deg_hist_l1"] == 0.0 and out["edge_feature_ks"]["ks_stat_max"] < 0.3 and len(out["node_feature_ks"]["per_dim"]["ks_pvalue"]) == 6


def test_external_sample(spark, tmp_path):
    x = spark.createDataFrame([(k, [[1.0, 0.0], [0.0, 1.0]], k % 2) for k in range(40)], "node long, features array<array<double>>, y int")
    g = build.from_sample(spark, x, spark.createDataFrame([(0, 1), (3, 2)], "u long, v long"), node_width=3, edge_width=2, edge_rate=0.1, seed=7, least_edges=200)
    assert 200 <= g.edges.count() <= 201 and g.nodes.first()["x"] == [0.0, 1.0, 0.0]
    csv.write_graph(g, str(tmp_path / "g"))
    assert csv.read_graph(spark, str(tmp_path / "g"), node_width=3, edge_width=2).edges.count() == g.edges.count()


def test_generator_input_and_samplers(graph):
    g = build.generator_input(graph, ["in_deg", "out_deg"])
    assert g.edges.filter("src = dst").count() == 0 and {r["column"] for r in build.marginals(g, ["in_deg"]).collect()} == {"in_deg"}
    stats, waves = build.sampler_comparison(graph, 30)
    assert {r["sample"] for r in stats.collect()} == {"full", "random", "snowball"} and sum(r["new_nodes"] for r in waves.collect()) <= 30


def test_experiment_on_stored_graphs(spark, folder, graph, tmp_path):
    """A stored graph of scalar columns, and a sample without splits and edge vectors, both train."""
    real = build.load_graph(spark, folder, max_transactions=300)
    csv.write_graph(build.degree_preserving(real, 7), str(tmp_path / "a"))
    g, names = build.from_files(spark, str(tmp_path / "a"), real), (real.meta["node_columns"], real.meta["edge_columns"])
    assert g.meta["generator"] == "from_files" and g.edges.count() == 300
    model = learn.trained(learn.Model(*map(len, names), learn.ModelConfig(hidden=4, emb=4)), learn.Arrays.of(g, *names), "edge", 2)
    assert np.isfinite(learn.logits(model, learn.Arrays.of(real, *names), "edge")).all()
    x = spark.createDataFrame([(k, [[1.0, 0.0], [0.0, 1.0]], k % 2) for k in range(40)], "node long, features array<array<double>>, y int")
    csv.write_graph(build.from_sample(spark, x, spark.createDataFrame([(0, 1)], "u long, v long"), node_width=2, edge_width=real.meta["edge_width"], edge_rate=0.0, rate_floor=0.2, seed=7, least_edges=100), str(tmp_path / "b"))
    g = build.from_files(spark, str(tmp_path / "b"), real)
    assert g.meta["edge_rate_drawn"] == 0.2 and {"split", *real.meta["node_columns"]} <= set(g.nodes.columns)
    assert learn.Arrays.of(g, real.meta["node_columns"], real.meta["edge_columns"]).attr.sum() == 0


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    from tallygraph import __main__ as command

    monkeypatch.setattr(learn.Transfer, "metrics", lambda *_: {k: dict.fromkeys(("roc_auc", "pr_auc", "f1"), 0.5) for k in ("train", "val", "test")})
    monkeypatch.setattr(report, "comparison", lambda *_, **__: {})

    out = str(tmp_path)
    command.main(["check"])
    command.main(["samplers", folder, "--max_transactions", "200", "--max_nodes", "30"])
    assert "snowball" in capsys.readouterr().out
    command.main(["prepare", folder, "--max_nodes", "40", "--out_dir", out])
    spark.createDataFrame([(k, [[1.0, 0.0]], k % 2) for k in range(30)], "node long, features array<array<double>>, y int").write.parquet(f"{out}/sample/nodes")
    spark.createDataFrame([(0, 1)], "u long, v long").write.parquet(f"{out}/sample/pairs")
    command.main(["convert", folder, "--sample", f"{out}/sample", "--min_directed_edges", "100", "--syn_edge_fraud_rate", "0.2", "--out_dir", out])
    short = [x for name in ("node_epochs", "edge_epochs", "syn_node_epochs", "syn_edge_epochs") for x in (f"--{name}", "1")]
    command.main(["experiment", folder, "--generator", "from_files", "--synthetic", f"{out}/synthetic", "--min_synthetic_nodes", "10", "--edges_only", "--use_dp", "--dp_steps_per_epoch", "1", "--checkpoint_dir", f"{out}/weights", "--out_dir", out, *short])
    found = json.loads(next(tmp_path.glob("transfer_*_from_files_edgesonly_dp.json")).read_text())
    assert found["dp_accounting"]["edge_syn"]["total_optimizer_steps"] == 1 and (tmp_path / "weights" / "edge_real" / "epoch_0001.npz").exists() and found["edge_checkpoint_dir"] == found["checkpoint_dir"] == f"{out}/weights"


def test_accounts_of_several_files_keep_their_order(spark, tmp_path):
    for part in range(3):
        rows = "".join(f"{part},b{part * 2 + k},Kind #{k}\n" for k in range(2))
        (tmp_path / f"part-{part}.csv").write_text(" Bank ID,Account Number,Entity Name\n" + rows + "9,first,Other #1\n")
    found = csv.read_accounts(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["row_id"] for r in found] == list(range(9))
    assert [r["account_id"] for r in found] == ["b0", "b1", "first", "b2", "b3", "first", "b4", "b5", "first"]


def test_written_accounts_come_back(spark):
    rows = spark.createDataFrame([("c", 3.0, "X #1", 2), ("a", None, "Y #2", 0), ("b", 1.0, None, 1)], "account_id string, bank double, name string, at int")
    found = csv.read_accounts(spark, csv.write_accounts(rows, "at")).orderBy("row_id").collect()
    assert [(r["account_id"], r["bank"], r["name"]) for r in found] == [("a", None, "Y #2"), ("b", 1.0, None), ("c", 3.0, "X #1")]


def test_epsilon_of_many_pools_is_that_of_each(spark):
    sizes = [1, 64, 65, 1000, 10**9]
    for noise in (0.7, 2.0):
        config = learn.PrivacyConfig(batch=64, noise=noise)
        found = {r["rows"]: r for r in learn.epsilons(spark.createDataFrame([(n,) for n in [0, *sizes]], "rows long"), config, 50).collect()}
        for n in sizes:
            wanted = learn.epsilon(config, min(1.0, 64 / n), 50)
            assert abs(found[n]["epsilon"] - wanted) < 1e-9 * max(1.0, wanted)
        assert found[0]["epsilon"] is None and found[0]["rate"] is None
    assert learn.epsilons(spark.createDataFrame([(5,)], "rows long"), learn.PrivacyConfig(noise=0.0), 50).first()["epsilon"] is None
