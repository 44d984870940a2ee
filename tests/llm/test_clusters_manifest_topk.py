"""Clustering, the manifest and top-k search against plain versions, and on nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.llm import clustering, kernel, merkle, shared, top_search

VECTORS = "vec_id long, embedding array<float>"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vectors(n, size, seed=3):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.normal(0, 0.3, size).astype(np.float32)]) for k in range(n)]


def odd_vectors(size):
    plain = vectors(60, size)
    return [*plain, plain[5], (5, plain[6][1]), (None, plain[7][1]), (70, None), (71, []), (72, [1.0] * (size - 1)), (73, [None] + [1.0] * (size - 1)), (74, [math.nan] * size), (75, [math.inf] + [0.0] * (size - 1)), (76, [0.0] * size), (77, plain[8][1]), (80, [1e30] * size)]


# clustering


def plain_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


@pytest.mark.parametrize("k", [1, 7, 200])
def test_clusters(spark, k):
    rows = odd_vectors(8)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("cluster", "v", "n", "distance", "t0")})
    out = clustering.cluster(df, k=k, rounds=3, dimensions=8)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r[c] for c in names) for r in out.collect()), key=repr) == plain_clusters(rows, k, 3, 8)


def test_empty_clusters_and_no_vectors(spark):
    same = spark.createDataFrame([(k, [0.5, 0.5]) for k in range(9)], VECTORS)
    out = clustering.cluster(same, k=3, rounds=2, dimensions=2).collect()
    assert {(r["cluster"], r["distance"], r["members"]) for r in out} == {(0, 0, 9)}  # ties go to the smaller number
    assert clustering.cluster(same.limit(0), dimensions=2).count() == 0 and clustering.cluster(same, dimensions=5).count() == 0


def test_walk_stops_early_and_is_exact():
    """On spread centroids in few dimensions most vectors stop before the lists end."""
    rng = np.random.default_rng(1)
    centroids, x = rng.integers(-999, 999, (300, 2)), rng.integers(-999, 999, (500, 2))
    cluster, distance, steps = clustering.CentroidLists(centroids).nearest(x)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all() and np.mean(steps) < 30


def test_ties_on_the_frontier():
    """A centroid exactly as far as the frontier may still tie with the best, and has the smaller number."""
    rng = np.random.default_rng(2)
    centroids, x = rng.integers(-2, 3, (40, 3)), rng.integers(-2, 3, (200, 3))
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (clustering.CentroidLists(centroids).nearest(x)[0] == every.argmin(1)).all()


# manifest


def plain_tree(nodes):
    """Levels of a tree over digests, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256("".join(out[-1][k : k + 8]).encode()).hexdigest() for k in range(0, len(out[-1]), 8)])
    return out


def plain_proof(tree, k):
    out = []
    for level in tree[:-1]:
        run = level[k // 8 * 8 : k // 8 * 8 + 8]
        out.append((run[: k % 8], run[k % 8 + 1 :]))
        k //= 8
    return out


def plain_manifest(rows):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, s, n: hashlib.sha256("".join(map(part, (i, s, lang, n, t))).encode()).hexdigest()
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    trees = defaultdict(list)
    for i, t, lang, s, n in rows:
        hit = i is not None and t is not None and zlib.crc32(str(i).encode()) % 3 == 0
        trees[lang].append((i, leaf(i, t, lang, s, n), leaf(i, t.translate(lower) if hit else t, lang, s, n)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    built = {x: plain_tree([r[1] for r in trees[x]]) for x in order}
    outer, out = plain_tree([built[x][-1][0] for x in order]), []
    for nth, x in enumerate(order):
        for k, (i, own, claim) in enumerate(trees[x]):
            proof = plain_proof(built[x], k) + plain_proof(outer, nth)
            folded = claim
            for left, right in proof:
                folded = hashlib.sha256("".join([*left, folded, *right]).encode()).hexdigest()
            whole = hashlib.sha256("".join(d for left, right in proof for d in left + right).encode()).hexdigest()
            out.append((i, own, built[x][-1][0], outer[-1][0], whole, folded, folded == outer[-1][0]))
    return sorted(out, key=repr)


def checked(spark, rows, extra=()):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in extra})
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    out = merkle.verified(df, F.when(hit, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text")))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in out.collect()), key=repr)


def test_manifest(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "cd", "é", "日本", ""])
    rows = [(k, " ".join(word() for _ in range(rng.randrange(9))), rng.choice(["en", "de", "Z", "é"]), "s", k) for k in range(700)]
    rows += [(900, "Alone", "xx", None, None), (901, None, None, None, None), (None, "No id", "en", "s", 1), (None, "No id", "en", "s", 1), (None, None, None, None, None), (3, "Another text", "en", "s", 1), rows[0], rows[0], (902, "Long " * 200_000, "en", "s", 1)]
    want = plain_manifest(rows)
    assert checked(spark, rows, ("tree", "rank", "key", "claim", "digest", "block", "total", "log", "way", "nth", "part")) == want
    assert checked(spark, rows[::-1]) == want  # the order of rows does not matter


def test_trees_of_several_blocks(spark):
    """Full and partial last blocks, next to trees of one block."""
    rows = [(k, f"Text {k}", "en", "s", 1) for k in range(2 * merkle.BLOCK + 1)] + [(k, f"Text {k}", "de", "s", 1) for k in range(merkle.BLOCK)] + [(5, "Lone", "fr", "s", 1)]
    assert checked(spark, rows) == plain_manifest(rows)


def test_small_manifests(spark):
    for n in (1, 2, 8, 9, 64, 65):
        rows = [(k, f"Text {k}", "en", "s", 1) for k in range(n)]
        assert checked(spark, rows) == plain_manifest(rows)
    assert checked(spark, []) == []


@pytest.mark.parametrize("leaves", [1, 7, 8, 9, 63, 64, 65, 73, 511, 513, 585])
def test_positions_of_the_log(leaves):
    """Every node stands where the closed form says."""
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(leaves)]
    log, tree = merkle.appended(digests, merkle.levels(leaves)), plain_tree([d.hex() for d in digests])
    assert len(log) == 32 * sum(map(len, tree))
    for level, nodes in enumerate(tree):
        for k, node in enumerate(nodes):
            at = 32 * merkle.position(level, k, leaves)
            assert log[at : at + 32].hex() == node


# top-k


def plain_top(rows, k, every):
    fits = lambda v: v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and fits(v)]
    asking = {}
    for i, v in kept:
        if i % every == 0:
            asking[i] = min(v, asking.get(i, v))
    out = []
    for q, a in asking.items():
        near = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in kept if i != q and len(v) == len(a))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [None, 7])
@pytest.mark.parametrize("k", [1, 10, 100])
def test_top_products(spark, k, shard_rows):
    rows = odd_vectors(6)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("query_id", "rank", "score", "dim", "shard", "kind", "v", "asks")})
    out = top_search.top_products(df, F.col("vec_id") % 4 == 0, k=k, shard_rows=shard_rows)
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in out.collect()) == plain_top(rows, k, 4)


def test_hundreds_of_ties(spark):
    rows = [(k, [float(k % 3), 1.0 - k % 2, -1.0]) for k in range(600)]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(tuple(r) for r in top_search.top_products(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=100).collect()) == plain_top(rows, 5, 50)


def test_no_candidates(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], VECTORS)
    assert top_search.top_products(one, F.lit(True)).count() == 0 and top_search.top_products(one.limit(0), F.lit(True)).count() == 0


def test_maxscore_skips_and_is_exact(monkeypatch):
    """Sparse vectors with falling weights: after the first block most vectors are never probed."""
    monkeypatch.setattr(top_search, "BLOCK", 256)
    rng = np.random.default_rng(5)
    held = np.where(rng.random((4000, 40)) < 0.2, rng.integers(-1000, 1000, (4000, 40)) // np.arange(1, 41), 0)
    postings, probed = top_search.Postings(np.arange(4000), held), []
    competitive = top_search.Postings.competitive
    monkeypatch.setattr(top_search.Postings, "competitive", lambda self, *a: probed.append(found := competitive(self, *a)) or found)
    for q in range(0, 4000, 400):
        ids, scores = postings.best(q, held[q], 10)
        want = sorted((-int(held[q] @ v), i) for i, v in enumerate(held) if i != q)[:10]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == want
    assert np.mean([len(at) for at, _ in probed]) < 0.2 * 256


# shared parts


def test_any_size_setting_of_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for value, want in (("64m", str(shared.BATCH_BYTES)), ("1g", str(shared.BATCH_BYTES)), ("256k", "256k"), ("100000", "100000")):
            spark.conf.set(key, value)
            shared.bounded_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_second_blocks_solved_for_the_first_half():
    """After any two first blocks second ones can be chosen that make the first half of the state meet; the second half keeps the texts apart."""
    rng, u = np.random.default_rng(6), kernel.U64
    state = lambda block: kernel.mix((kernel.mix(np.array([16], u) + u(kernel._MULTIPLIER)) ^ block) * u(kernel._MULTIPLIER) + u(1))
    firsts = rng.integers(0, 2**63, (2000, 2)).astype(u)
    seconds = rng.integers(0, 2**63, 2000).astype(u)
    met = [seconds ^ state(firsts[:, 0]), seconds ^ state(firsts[:, 1])]
    texts = np.concatenate([np.stack([firsts[:, j], met[j]], 1) for j in range(2)]).astype("<u8")
    data, at = np.frombuffer(texts.tobytes(), np.uint8), np.arange(4001) * 16
    assert len(np.unique(kernel.run_hashes(data, at[:-1], at[1:]))) == 4000
    built = [b"mntyadvy!a!aa!a!", b"ipyvafxp[t_zuGfA", b"mntyadvy!!!!!&!;", b"ipyvafxp[4_:5@&["]
    raw, ends = np.frombuffer(b"".join(built), np.uint8), np.arange(5) * 16
    assert len(np.unique(kernel.run_hashes(raw, ends[:-1], ends[1:]))) == 4
    assert (kernel.run_hashes(raw, ends[:-1], ends[1:], 7) != kernel.run_hashes(raw, ends[:-1], ends[1:])).all()
