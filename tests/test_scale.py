"""Hubs, numbering and batches of many steps: bounded tasks, and the rows of plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallygraph import graph
from tallygraph.graph import Adjacency, both_ways, numbered, running
from tallygraph.operators import batches, sampling, structure


def random_edges(n=400, nodes=60, seed=1, hub=0):
    rng = random.Random(seed)
    ends = lambda: hub if rng.random() < 0.3 else rng.randrange(nodes)
    return [(k, ends(), rng.randrange(nodes), int(rng.random() < 0.2)) for k in range(n)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(random_edges(), "eid long, src long, dst long, y int")


def test_star_of_a_million_edges(spark):
    """The hub's list, the wave that starts at it and the wave that meets it are even over tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        star = spark.range(1_000_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
        near = Adjacency.of(both_ways(star))
        spread = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert near.hubs.collect() == [(-1, 489)]
        for rows in (near.blocks, near.met(spark.range(-1, 0).select(F.col("id").alias("at"))), near.met(star.select(F.col("dst").alias("at")))):
            held = spread(rows)
            assert sum(held) in (1_000_000, 2_000_000) and held[-1] <= 4 * median(held)
        found = sampling.grown(near, spark.range(3, 4).select(F.col("id").alias("node")), 2)
        assert found.count() == 1_000_001
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hub", [3, 10**6])
def test_searches_with_and_without_blocks(spark, edges, hub, monkeypatch):
    """Lists in blocks give the rows of plain search; parallel edges are met once, or each if asked."""
    monkeypatch.setattr(Adjacency.of.__func__, "__kwdefaults__", {"distinct": True, "hub": hub})
    rows = random_edges()
    out = defaultdict(set)
    for _, a, b, _ in rows:
        out[b].add(a)
    for hops in (0, 1, 2):
        kept = {5, 7}
        for _ in range(hops):
            kept |= {a for b in kept for a in out[b]}
        seeds = spark.createDataFrame([(5,), (7,), (5,)], "node long")
        assert sorted(r[0] for r in sampling.k_hop_in(edges, seeds, hops).collect()) == sorted(kept)
    near = batches.incoming_lists(edges)
    met = near.met(spark.createDataFrame([(0, 9), (1, 9)], "at long, tag long")).select("tag", "at", "node", "eid").collect()
    assert sorted(map(tuple, met)) == sorted((9, b, a, k) for k, a, b, _ in rows if b in (0, 1))


def test_path_lengths_with_blocks(spark, edges, monkeypatch):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    want = structure.path_lengths(nodes, edges, sources=10).collect()
    monkeypatch.setattr(Adjacency.of.__func__, "__kwdefaults__", {"distinct": True, "hub": 2})
    assert structure.path_lengths(nodes, edges, sources=10).collect() == want


def test_numbers_of_one_hour(spark):
    """All rows in one hour, or of one value, are numbered by as many tasks as others."""
    rows = spark.range(200_000).select(F.col("id"), F.timestamp_seconds(F.col("id") % 3600).alias("ts"), F.lit(1).alias("one"))
    for order in (("ts", "id"), ("one", "id")):
        held = numbered(rows, None, *order, name="nth")
        numbers = held.orderBy(*order).select("nth").collect()
        assert [r[0] for r in numbers] == list(range(200_000))
        sizes = [r["count"] for r in held.groupBy(F.floor(F.col("nth") / 50_000)).count().collect()]
        assert sizes == [50_000] * 4
    assert numbered(rows.limit(0), None, "id", name="nth").count() == 0


@pytest.mark.parametrize("many", [False, True])
def test_running_sums(spark, many):
    rows = spark.createDataFrame([(k, k % 7 + 1) for k in range(0, 900, 3)], "key long, n long")
    found = {r["key"]: r["start"] for r in running(rows, "key", "n", "start", many).collect()}
    total = 0
    for k in range(0, 900, 3):
        assert found[k] == total
        total += k % 7 + 1


def test_hash_buckets_beyond_the_limit(spark, monkeypatch):
    """First numbers added up over ranges give the same numbers."""
    rows = spark.range(5000)
    key = F.md5(F.col("id").cast("string").cast("binary"))
    want = {tuple(r) for r in graph.shuffled(rows, key, "id", name="nth").collect()}
    monkeypatch.setattr(graph, "BUCKETS", 10)
    assert {tuple(r) for r in graph.shuffled(rows, key, "id", name="nth").collect()} == want


# batches


@pytest.mark.parametrize(("batch", "ratio"), [(16, 1), (64, 3), (500, 1)])
def test_minibatches_meet_their_quota(edges, batch, ratio):
    from tallygraph.operators.splits import batch_quota

    p = edges.filter("y = 1").count()
    rows = batches.minibatches(edges, 9, batch, ratio, 7, first=2).collect()
    quota = batch_quota(batch, ratio, p, 400 - p)
    assert len({(r["step"], r["eid"]) for r in rows}) == len(rows)
    assert Counter((r["step"], r["y"]) for r in rows) == {(s, y): quota[1 - y] for s in range(2, 11) for y in (0, 1)}


def test_minibatches_draw_again_when_hashes_run_short(edges, monkeypatch):
    want = sorted(map(tuple, batches.minibatches(edges, 5, 40, 1, 7).collect()))
    monkeypatch.setattr(batches, "share_drawn", lambda take, size: 0.02)
    assert sorted(map(tuple, batches.minibatches(edges, 5, 40, 1, 7).collect())) == want


def test_minibatches_of_one_class(edges):
    rows = batches.minibatches(edges.filter("y = 0"), 3, 10, 3, 7).collect()
    assert Counter((r["step"], r["y"]) for r in rows) == {(s, 0): 10 for s in range(3)}
    assert batches.minibatches(edges.limit(0), 3, 10, 3, 7).count() == 0


@pytest.mark.parametrize("hops", [0, 1, 2])
def test_surroundings_of_many_steps(edges, hops):
    """Rows (step, node), (step, eid) and the last parallel edge are those of one plain search for each step."""
    rows = random_edges()
    drawn = batches.batch_edges(batches.minibatches(edges, 4, 6, 1, 3), edges)
    near = batches.incoming_lists(edges)
    kept = batches.surroundings(near, batches.batch_endpoints(drawn), hops)
    around = batches.surrounding_edges(near, kept)
    seen = {(r["step"], r["eid"]): r["seen"] for r in batches.local_edges(drawn, around).collect()}
    batch, nodes, own = defaultdict(list), defaultdict(set), defaultdict(set)
    for r in drawn.collect():
        batch[r["step"]].append((r["eid"], r["src"], r["dst"]))
    for step, drawn_edges in batch.items():
        at = {x for _, a, b in drawn_edges for x in (a, b)}
        for _ in range(hops):
            at |= {a for _, a, b, _ in rows if b in at}
        nodes[step] = at
        own[step] = {k for k, a, b, _ in rows if a in at and b in at}
        for k, a, b in drawn_edges:
            assert seen[step, k] == max(j for j, x, y, _ in rows if (x, y) == (a, b))
    assert {(r["step"], r["node"]) for r in kept.collect()} == {(s, v) for s, at in nodes.items() for v in at}
    found = around.collect()
    assert len(found) == len({(r["step"], r["eid"]) for r in found}) and {(r["step"], r["eid"]) for r in found} == {(s, k) for s, es in own.items() for k in es}
