"""What queries and searches leave in the shared folder, in bytes for each edge."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallygraph import graph
from tallygraph.operators import structure
from tallygraph.plans import roster

FOLDER = "/root/testdata/sf0.01"
LINES = 60_000


def left(spark, run):
    """Bytes that a run adds to the shared folder."""
    graph.shared_folder(spark, "")
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    size = lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    before = size()
    run()
    return size() - before


def test_search_stores_pairs_once(spark):
    edges = spark.range(200_000).select(F.col("id").alias("eid"), F.concat(F.lit("C"), F.col("id") % 5000).alias("src"), F.concat(F.lit("S"), F.col("id") * 7919 % 40_009).alias("dst"))
    nodes = spark.range(5000).select(F.concat(F.lit("C"), "id").alias("node"))
    assert left(spark, lambda: structure.path_lengths(nodes, edges, sources=20, cutoff=4).collect()) < 20 * 200_000


def test_rewired_histogram_numbers_edges_once(spark):
    assert left(spark, lambda: roster.QUERIES["q_hist_l1"](spark, FOLDER).collect()) < 14 * LINES


@pytest.mark.parametrize("broadcast", [0, 30, 500_000])
def test_distances_of_many_sources(spark, monkeypatch, broadcast):
    """More sources than bits of a row, a hub in blocks, nodes that are structs, and sources without edges; waves sent to the pairs and dealt by key."""
    import random

    monkeypatch.setattr(structure, "BROADCAST", broadcast)
    monkeypatch.setattr(graph.Adjacency.over.__func__, "__defaults__", (3,))
    rng = random.Random(5)
    pairs = [(0, k) for k in range(60)] + [(rng.randrange(100), rng.randrange(100, 200)) for _ in range(150)] + [(7, 7)]
    near = {k: set() for k in range(210)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, start = set(), [k for k in range(210) if k % 2 or k > 190]
    for source in start:
        seen, last = {source}, {source}
        want.add((source, source, 0))
        for dist in (1, 2, 3):
            last = {b for a in last for b in near[a]} - seen
            seen |= last
            want |= {(source, b, dist) for b in last}
    node = lambda c: F.struct(F.col(c).alias("id"), F.lit(1).alias("g")).alias(c)
    edges = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "eid long, src long, dst long").select("eid", node("src"), node("dst"))
    found = structure.distances(spark.createDataFrame([(k,) for k in start], "node long").select(node("node")), edges, 3)
    rows = sorted(map(tuple, found.select("source.id", "at.id", "dist").collect()))
    assert rows == sorted(want)


@pytest.mark.parametrize("name", ["q_built_nodes", "q_built_edges"])
def test_built_graph_leaves_packed_files_and_its_own_tables(spark, name):
    assert left(spark, lambda: roster.QUERIES[name](spark, FOLDER).collect()) < 80 * LINES


def test_numbered_lines(spark):
    rows = spark.createDataFrame([("b", 70, "x"), ("a", 5, "z"), ("b", 71, "y"), ("a", 6, "w"), ("c", 0, "v")], "part string, line long, v string")
    assert [r["v"] for r in graph.numbered_lines(rows, "part", "line", name="n").orderBy("n").collect()] == ["z", "w", "x", "y", "v"]


def test_passing_tables_are_deleted(spark):
    with graph.passing(spark):
        with graph.passing(spark):
            gone, kept = graph.stored(spark.range(3)), graph.stored(spark.range(5), lasting=True)
            assert gone.count() == 3
        again = graph.stored(kept, lasting=True)
        assert kept.count() == 5
    exists = lambda df: any(__import__("os").path.exists(f.removeprefix("file://")) for f in df.inputFiles())
    assert not exists(gone) and not exists(kept) and exists(again) and again.count() == 5


def test_packed_files_keep_order(spark, monkeypatch):
    """Several files of a task, and of several tasks, give the lines in order."""
    from tallygraph.sources import csv

    monkeypatch.setattr(csv, "LINES", 70)
    made = spark.range(1000).selectExpr("id AS eid", "concat('A', id) AS src", "'B' AS dst", "timestamp '2024-01-01' AS ts", "1.5D AS amt", "'Wire' AS fmt", "0 AS y")
    folder = csv.write_transactions(made.repartition(5))
    assert len(spark.read.text(folder).inputFiles()) >= 15
    for prefix, want in ((None, 1000), (333, 333)):
        assert sorted((r["eid"], r["src"]) for r in csv.read_transactions(spark, folder, prefix=prefix).collect()) == [(k, f"A{k}") for k in range(want)]
