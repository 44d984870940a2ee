"""The first ten operators against plain versions, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallygraph.llm import context_tree, decontaminate, entry, language_id, near_dup, neighbours, packing, secret_scan, substring_dedup, suffix_array, token_count, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_texts():
    """Texts with what real ones have now and then."""
    rng = random.Random(5)
    base = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(120))
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        None, "", " \n\t ", "one", "One", "two words", "a b c d", "a b c d e", base, base, base.upper(), near, base + " tail", long, long + " x", "é" * 60, "日本語 テキスト " * 20,
        "password = 'abc' token=secret=abcdef1 AKIA" + "A1" * 10 + " " + "0f" * 15 + " PASSWORD:\"x\"", "\x00\x01 control", "<|endoftext|> mark <|endoftext|>", "ΑΣ Σας don't 'S",
        "x" * 49, "y" * 50, "y" * 51, "a b\x1cc d",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", None) for k, t in enumerate(odd_texts())]
    rows += [(8, rows[8][1], "en", "s", 1), (None, "a row without an id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + "").withColumns({c: F.lit(1) for c in ("key", "a", "b", "n", "shard", "rank", "digest", "at", "score")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def real(n=None):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    return rows[:n]


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# near duplicates


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows, similarity=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= similarity * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def test_near_duplicates(spark, docs):
    found = near_dup.near_duplicates(docs, similarity=85)
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert by_row(found.filter("doc_id IS NOT NULL"), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert by_row(found.filter("doc_id IS NULL"), "component_id", "kept") == [(None, True)] * 2


def test_near_duplicates_of_real_documents(spark):
    found = near_dup.op1_near_duplicates(spark, SF)
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain_components(real()), key=repr)


def test_long_lists_and_heavy_groups(spark, monkeypatch):
    """Many near copies of one text, with lists and groups made small: the same components."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dup, "LONG", 8)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    monkeypatch.setattr(near_dup, "DEALT", 10)
    monkeypatch.setattr(near_dup, "HEAVY", 600)
    for similarity in (80, 85):
        found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity)
        assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain_components(rows, similarity), key=repr)


def test_short_variants_in_long_lists(spark):
    """Templates of 10 to 25 words with over 2000 variants by one word more or other, at the real constants: brute force."""
    rng, rows = random.Random(4), []
    for words, many in ((10, 1200), (14, 500), (25, 600)):
        base = [f"t{words}n{k}" for k in range(words)]
        for k in range(many):
            w = list(base)
            if k and k % 3 == 0:
                w[rng.randrange(words)] = f"other{k}"
            rows.append((len(rows), " ".join(w if k % 3 == 0 else [*w, f"last{k}"] if k % 3 == 1 else [f"first{k}", *w])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (80, 85):
        found = by_row(near_dup.near_duplicates(df, similarity=similarity), "doc_id", "n_shingles", "component_id", "kept")
        assert found == sorted(plain_components(rows, similarity), key=repr)


def test_unlike_documents_in_long_lists(spark, monkeypatch):
    """One passage in documents that are otherwise apart, with links among few of them: the same components, whoever the pivots are."""
    monkeypatch.setattr(near_dup, "LONG", 16)
    monkeypatch.setattr(near_dup, "PIVOTS", 4)
    monkeypatch.setattr(near_dup, "DEALT", 20)
    rng, rows, shared = random.Random(7), [], [f"s{k}" for k in range(60)]
    for k in range(120):
        w = shared + [f"own{k // 2}w{j}" for j in range(60)]
        if k % 2:
            w[60 + rng.randrange(60)] = f"changed{k}"
        rows.append((k, " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain_components(rows, 80), key=repr)


def test_thousands_of_documents_with_one_head(spark):
    """A head of 40 words before 60 own ones, and copies of some with a word changed: all found, by lists of rare values rather than all with all."""
    rng, rows, head = random.Random(8), [], [f"h{k}" for k in range(40)]
    for k in range(6000):
        w = head + [f"own{k}w{j}" for j in range(60)]
        rows.append((k, " ".join(w)))
        if k % 40 == 0:
            w[60 + rng.randrange(30)] = f"changed{k}"
            rows.append((10_000 + k, " ".join(w)))
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i % 10_000 for i, _ in rows}


def test_small_sets_of_all_sizes(spark):
    rng, rows = random.Random(6), []
    for size in range(1, 71):
        base = [f"s{size}w{k}" for k in range(size + 4)]
        for k in range(6):
            w = list(base)
            for _ in range(k // 2):
                w[rng.choice([0, -1, rng.randrange(len(w))])] = f"x{size}y{k}{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (80, 85):
        found = by_row(near_dup.near_duplicates(df, similarity=similarity), "doc_id", "n_shingles", "component_id", "kept")
        assert found == sorted(plain_components(rows, similarity), key=repr)


def test_repeated_ids_with_different_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (5, a), (7, a + " more"), (9, b + " more"), (3, b + " more too"), (8, "apart from all the others here")]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(found, "doc_id", "component_id") == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (8, 8), (9, 3)]


def test_similarity_estimate_and_intersections():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:3600], rng.integers(0, 2**63, 400).astype(np.uint64)]))
    sketch = [(s[: near_dup.RETAINED] >> np.uint64(32)).astype(np.uint32) for s in (a, b)]
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(near_dup.similarity_estimates(sketch)[0, 1] - true) < 0.2
    assert near_dup.intersections([a, b, a[:10]])[0].tolist()[1:] == [len(np.intersect1d(a, b)), 10]


# substring removal


def plain_removal(rows):
    first, out = {}, []
    texts = [(2**63 - 1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, b in texts:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], key), key)
    for key, i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_substring_removal(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert by_row(substring_dedup.substring_dedup(docs), *COLUMNS) == plain_removal(rows)


def test_substring_removal_of_real_documents(spark):
    assert by_row(substring_dedup.op2_substring_dedup(spark, SF), *COLUMNS) == plain_removal(real())


def test_removal_of_long_runs_and_periods(spark):
    """One letter for 300,000 bytes, a period longer and shorter than a window, and one passage in every document."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(1, "a" * 300_000), (2, "b" + "a" * 60), (3, "ab" * 20_000), (4, "ba" * 100), (5, (passage[:57] + "!") * 40), (6, passage[:57] + "!" + passage[:30])]
    rows += [(10 + k, "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + passage + "".join(rng.choice("xyz") for _ in range(20))) for k in range(150)]
    assert by_row(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")), *COLUMNS) == plain_removal(rows)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = np.append(rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 50))), 0)
        assert suffix_array.suffix_array(s, 5).tolist() == sorted(range(len(s)), key=lambda k: s.tolist()[k:])


def test_common_prefixes():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 8, np.uint8)
    order = np.array([0, 26, 52, 160, 1])
    assert suffix_array.permuted_common_prefixes(data, order, 50)[order].tolist() == [0, 50, 50, 0, 0]


# url filter


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")), ("no scheme/en/7", ("", "", None, "allow")), ("http://EXAMPLE.com/en/7x?q#f", ("example.com", "/en/7x", "example.com/en/7", "allow")),
        ("http://a.com/en/8", ("a.com", "/en/8", "com/en/", "block")), ("http://notcom/en/8", ("notcom", "/en/8", None, "allow")), ("http://x.example.net/de/81", ("x.example.net", "/de/81", "example.net/de/8", "block")),
        ("http://x.net/de/81", ("x.net", "/de/81", "net/de/", "allow")), ("http://spam-farm.io", ("spam-farm.io", "", None, "block")), ("http://xspam-farmx.io/", ("xspam-farmx.io", "/", None, "allow")),
        ("http://free.io/bonus", ("free.io", "/bonus", None, "block")), ("http://free.io/free", ("free.io", "/free", None, "allow")), ("://h?x", ("h", "", None, "allow")),
    ],
)
def test_url(spark, url, want):
    r = url_filter.url_filter(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()[0]
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == want


def test_odd_pages(spark):
    long = "http://h.io/" + "x/" * 200_000 + "porn"
    rows = [(None, "http://porn.io/", 1), (1, None, 1), (1, "http://ok.io/", 1), (1, "http://ok.io/", 1), (2, long, 1), (3, "http://free.io/" + "free/" * 10_000, 1)]
    found = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, verdict int").withColumn("host", F.lit(0)))
    assert by_row(found, "page_id", "verdict") == sorted([(None, "block"), (1, "allow"), (1, "allow"), (1, "allow"), (2, "block"), (3, "allow")], key=repr)


def test_vocabulary_of_thousands_of_weighted_terms(spark):
    """Boundaries and distinctness against regular expressions, with terms within terms."""
    rng = random.Random(11)
    terms = {"".join(rng.choice("abcde-") for _ in range(rng.randrange(2, 7))).strip("-") or "zz": rng.choice([0.5, 1.0, 2.0, 5.0]) for _ in range(4000)}
    table = spark.createDataFrame([*terms.items(), ("AB", 0.5), ("", 9.0), (None, 9.0), ("never", 0.0)], "term string, weight double")
    words = url_filter.Vocabulary.of(table, soft_limit=3)
    strict, soft = {t for t, w in terms.items() if w >= 2}, {t for t, w in terms.items() if w < 2} | {"ab"} - {t for t, w in terms.items() if w >= 2}
    assert set(words.strict) == strict and set(words.soft) == soft and len(words.strict) + len(words.soft) > 1900
    urls = ["http://" + "".join(rng.choice("abcde-./") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    hits = lambda terms, u: {t for t in terms if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", u)}
    found = {r["page_id"]: r for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), vocabulary=words, rules=()).collect()}
    for k, u in enumerate(urls):
        a, b = len(hits(strict, u)), len(hits(soft, u))
        assert (found[k]["n_strict"], found[k]["n_soft"], found[k]["verdict"]) == (a, b, "block" if a or b >= 3 else "allow")
    with pytest.raises(ValueError):
        url_filter.Vocabulary.of(table, most=10)
    assert url_filter.url_filter(spark.createDataFrame([(1, "http://porn.io")], "page_id long, url string"), vocabulary=url_filter.Vocabulary((), ())).collect()[0]["verdict"] == "allow"


# nearest neighbours


def plain_nearest(rows, k):
    usable = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    return {q: [i for _, i in sorted((-float(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:k]] for q in usable if q % 20 == 0}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(60)]  # ties
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, [float("inf")] * 8), (500, []), (520, [1.0, 2.0]), (None, [1.0] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    for factor, size in ((1.0, 64), (1.1, 4096)):
        found = defaultdict(list)
        for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=size).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append(r["vec_id"])
        want = plain_nearest(rows, 20)
        assert {q: v for q, v in want.items() if v} == dict(found)
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_hundreds_of_ties(spark):
    """Integer vectors of which most tie at the last place, in one shard and in several: exact at factor 1."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(-1, 2, 6)]) for k in rng.permutation(1500).tolist()]
    rows += [(2000 + k, [1.0, 1.0, 1.0, 1.0, 0.0, float(k)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain_nearest(rows, 20)
    for size in (100, 5000):
        found = defaultdict(list)
        for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=size).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append(r["vec_id"])
        assert {q: v for q, v in want.items() if v} == dict(found)


def test_pairs_are_reduced_as_they_grow(monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 10)
    ids, vectors = np.arange(5000), np.zeros((5000, 4))
    vectors[:, 0], vectors[:, 1] = 1, np.arange(5000)
    tree = neighbours.VantageTree(ids, vectors, float((vectors**2).sum(1).max()))
    assert tree.nearest(np.array([0, 7]), np.array([[1.0, 0, 0, 0]] * 2), 20, 1.0)[0] == [list(range(1, 21)), [k for k in range(21) if k != 7]]


def test_recall_on_real_vectors(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    want = plain_nearest([(i, list(v)) for i, v in rows], 20)
    found = defaultdict(set)
    for r in neighbours.op4_nearest(spark, SF).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(found[q] & set(v)) / len(v) for q, v in want.items()]) >= 0.9


# tokens and packing


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts(spark, docs):
    tokenizer = library("byte_bpe_50k.json")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in rows), key=repr)
    assert by_row(token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_counts_of_random_texts():
    tokenizer, own, rng = library("byte_bpe_50k.json"), token_count.Counter(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    texts = ["".join(rng.choice(" '\n\t\x1c\x85srevlltmdaé1!?x日") for _ in range(rng.randrange(0, 600))) for _ in range(400)] + [t for _, t in real(60)]
    assert own.counts(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, docs):
    tokenizer = library("word_bpe_49k.json")
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_encoder_on_random_texts():
    tokenizer, own, rng = library("word_bpe_49k.json"), packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    texts = ["".join(rng.choice(" '\n\t\x1c\x85srevlltmdaé1!?x日ΣÉİ<|½_́") for _ in range(rng.randrange(0, 300))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        size = rng.choice([10, 20, 64])
        wanted = {n: rng.randrange(1, 30) for n in rng.sample(range(1, size + 1), rng.randrange(1, min(size, 12)))}
        runs, bins = packing.plan(wanted, size)
        free: list[int] = []
        for n in sorted(wanted, reverse=True):
            for _ in range(wanted[n]):
                fit = [(x, k) for k, x in enumerate(free) if x >= n]
                if fit:
                    free[min(fit)[1]] -= n
                else:
                    free.append(size - n)
        assert bins == len(free)
        used: dict[int, list] = defaultdict(list)
        for n, own in runs.items():
            for k in range(wanted[n]):
                first, each, bin0, offset = [x for x in own if x[0] <= k][-1]
                used[bin0 + (k - first) // each].append((offset + (k - first) % each * n, n))
        for own in used.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= size


# secrets


def plain_spans(text):
    text = text or ""
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(((r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= n]
    return sorted(found), [sum(k == j for _, k, _ in found) for j in range(3)]


def test_secrets(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(900 + i, t) for i, t in real(80)]
    want = []
    for i, t in rows:
        found, counts = plain_spans(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        want.append((i, *counts, hashlib.sha256(text.encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(secret_scan.secret_scan(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    assert secret_scan.secret_scan(docs).count() == docs.count()


def test_ledger_scans_only_what_is_new(spark):
    df = spark.createDataFrame([(1, "secret=abcdef1"), (2, "secret=abcdef1"), (3, "clean")], "doc_id long, text string")
    ledger = secret_scan.scan(df)
    assert ledger.count() == 2 * len(secret_scan.RULES) and secret_scan.scan(df, ledger=ledger).count() == 0
    newer = (*secret_scan.RULES[:-1], secret_scan.Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{30,}", version=2))
    assert [r["version"] for r in secret_scan.scan(df, newer, ledger).collect()] == [2, 2]
    more = df.unionAll(spark.createDataFrame([(4, "token: zzzzzz9")], "doc_id long, text string"))
    assert by_row(secret_scan.secret_scan(more, ledger=ledger), "doc_id", "n_assign") == [(1, 1), (2, 1), (3, 0), (4, 1)]
    masked = secret_scan.masked(more, secret_scan.findings(secret_scan.scan(more)))
    assert by_row(masked, "doc_id", "text") == [(1, "*" * 14), (2, "*" * 14), (3, "clean"), (4, "*" * 14)]


def test_many_matches_and_odd_columns(spark):
    text = " ".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(1500)) + " secret=abcdef1 end"
    df = spark.createDataFrame([(1, text, 0, 0, "x"), (None, None, 0, 0, "y"), (2, "", 0, 0, "z")], "doc_id long, text string, found int, _blob int, salt string")
    assert by_row(secret_scan.secret_scan(df), "doc_id", "n_hex", "n_assign") == sorted([(1, 1500, 1), (2, 0, 0), (None, 0, 0)], key=repr)
    spans = [tuple(map(int, x.split(":")[1:])) for x in secret_scan.secret_scan(df).filter("doc_id = 1").first()["spans"].split(",")]
    assert spans == [(33 * k, 33 * k + 32) for k in range(1500)] + [(33 * 1500, 33 * 1500 + 14)]
    masked = secret_scan.masked(df, secret_scan.findings(secret_scan.scan(df)))
    assert masked.columns == df.columns
    assert by_row(masked, "doc_id", "text", "salt") == sorted([(1, re.sub(r"[0-9a-f]{32}|secret=abcdef1", lambda m: "*" * len(m[0]), text), "x"), (None, None, "y"), (2, "", "z")], key=repr)


def test_stored_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, "secret=abcdef1"), (2, "clean")], "doc_id long, text string")
    more = one.unionAll(spark.createDataFrame([(3, "token: zzzzzz9"), (4, "secret=abcdef1")], "doc_id long, text string"))
    rules = len(secret_scan.RULES)
    assert secret_scan.read_ledger(spark, path).count() == 0
    assert secret_scan.scan_into(one, path).count() == 2 * rules and secret_scan.scan_into(one, path).count() == 2 * rules
    ledger = secret_scan.scan_into(more, path)
    assert ledger.count() == 3 * rules
    assert by_row(secret_scan.joined_back(more, secret_scan.findings(ledger)).select("doc_id", F.size("found").alias("n")), "doc_id", "n") == [(1, 1), (2, 0), (3, 1), (4, 1)]
    newer = (*secret_scan.RULES[:-1], secret_scan.Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{30,}", version=2))
    both = secret_scan.scan_into(more, path, newer)
    assert both.count() == 3 * rules + 3 and secret_scan.compacted(both.unionAll(both), newer).count() == 3 * rules


# decontamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (20, 60))
        assert decontaminate.edit_distance(item, text, 99) == plain_distance(item, text)


def test_decontamination(spark, docs):
    item = "the quick brown fox jumps over the lazy dog while twelve curious zebras observe the scene from a distant hill"
    edited = item.replace("curious zebras", "curius zebra").replace("quick", "quik")
    bench = spark.createDataFrame([(1, item), (2, item.upper() + "!"), (3, None), (4, ""), (5, "one"), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    rows = [(100, "Before. " + item.title() + " after."), (101, "x " * 50 + edited), (102, "clean text " * 30), (103, item[:40]), (100, item), (104, None), (105, "")]
    found = decontaminate.contaminated(docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string")), bench)
    want = {(100, 1): 0, (100, 2): 0, (101, 1): plain_distance(item, edited), (101, 2): plain_distance(item, edited), (3, 5): 0, (4, 5): 0}
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found.collect()} == want
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_all_exact_passages(spark):
    normal = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = {(i, j) for i, t in real() for j, x in items if normal(x) in normal(t)}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.op8_decontaminate(spark, SF).collect()}
    assert want <= found and len(found - want) <= 0.02 * max(len(found), 1) + 1


def blurred(rng, text, share):
    """The text with that share of its characters edited at random places."""
    t = list(text)
    for p in rng.sample(range(len(t)), math.floor(share * len(t))):
        t[p] = rng.choice(["", "q", t[p] + "z"])
    return "".join(t)


def test_decontamination_finds_passages_of_all_sizes(spark):
    """Random edits and a typo in every third word, in items of 4 to 60 words: no false pair, true distances, and few are missed."""
    rng, pool = random.Random(5), ["".join(random.Random(k).choices("abcdefghiklmnoprstu", k=3 + k % 6)) for k in range(300)]
    items = [" ".join(rng.choices(pool, k=n)) for n in (2, 4, 8, 15, 30, 40, 60)] + ["é".join(rng.choices(pool, k=12))]
    ways = [lambda t, s=s: blurred(rng, t, s) for s in (0.05, 0.1, 0.2)]
    ways.append(lambda t: " ".join("#".join((w[:1], w[2:])).replace("#", "q") if k % 3 == 1 else w for k, w in enumerate(t.split())))
    fill = lambda: " ".join(rng.choices(pool, k=40))
    rows = [(n, f"{fill()} {way(items[n % len(items)])} {fill()}") for n, way in enumerate(w for w in ways * 4 for _ in items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    normal = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
    want = {(i, j): n for i, t in rows for j, x in enumerate(items) if (n := decontaminate.edit_distance(x, normal(t), len(x) // 5)) <= len(x) // 5}
    assert found.items() <= want.items() and len(want) > 0.9 * len(rows) and len(found) >= 0.97 * len(want)


def test_decontamination_of_unspaced_and_short_items(spark):
    items = ["東京都の人口は何人ですか", "quartz violin jubilee", "zyx"]
    texts = ["昨日聞いた話では東京都の人口は何人ですかと書いてあった", "a quartz viulin jubilee then", "so zyx it is", "a text long enough that azyx in it stands past one block"]
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{n} long, text string") for x, n in ((texts, "doc_id"), (items, "item_id")))
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == {(0, 0, 0), (1, 1, 1), (2, 2, 0)}


def test_recall_at_every_share_of_edits(spark):
    """Real items with random character edits, in real text: what the exact distance over all positions finds, the windows find."""
    rng, normal = random.Random(3), lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
    items = [normal(t) for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/benchmark.parquet' ORDER BY item_id").fetchall()]
    fill = " ".join(normal(t) for _, t in real(100))
    held = decontaminate.Items(list(range(len(items))), items)
    for share in (0.05, 0.1, 0.15, 0.18, 0.2):
        texts = [f"{fill[p : p + 300]} {blurred(rng, t, share)} {fill[p + 300 : p + 600]}" for t in items for p in [rng.randrange(len(fill) - 600)]]
        found = held.found(pa.array(texts))
        want = {k: n for k, t in enumerate(texts) if (n := decontaminate.edit_distance(items[k], normal(t), len(items[k]) // 5)) <= len(items[k]) // 5}
        hits = [k for k in want if (k, k) in found]
        assert len(want) > 0.9 * len(items) and len(hits) >= (0.9 if share > 0.15 else 0.98) * len(want)
        assert all(found[k, k] == want[k] for k in hits)


@pytest.mark.parametrize("length", [24, 30, 40, 60, 72, 80, 90, 100, 111, 112, 140])
def test_recall_in_every_class_of_lengths(length):
    """Items cut to a length, by share of random edits; the short ones of a size are the hardest."""
    rng, normal = random.Random(length), lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
    long = " ".join(normal(t) for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/benchmark.parquet' ORDER BY item_id").fetchall())
    items = [x for p in rng.sample(range(len(long) - length), 200) if len(x := long[p : p + length].strip()) == length][:120]
    fill = " ".join(normal(t) for _, t in real(100))
    held = decontaminate.Items(list(range(len(items))), items)
    for share in (0.1, 0.18, 0.2):
        texts = [f"{fill[p : p + 300]} {blurred(rng, t, share)} {fill[p + 300 : p + 600]}" for t in items for p in [rng.randrange(len(fill) - 600)]]
        found = held.found(pa.array(texts))
        want = [k for k, t in enumerate(texts) if decontaminate.edit_distance(items[k], normal(t), length // 5) <= length // 5]
        assert len(want) > 0.9 * len(items) and np.mean([(k, k) in found for k in want]) >= 0.93


def test_walks_keep_few_edits_few():
    """An embedding agrees on more positions the fewer edits there are, and on few for unrelated texts."""
    rng, size = random.Random(1), decontaminate.SIZES[0]
    masks, flips = (np.random.default_rng(1).integers(0, n, size.steps).astype(np.uint8) for n in (256, 2))
    walk = lambda t: decontaminate.embedded(decontaminate.symbols_of(t + "\0" * size.steps), np.zeros(1, np.int64), masks, flips)[:, 0]
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(64))
    agree = lambda share: np.mean([(walk(t) == walk(blurred(rng, t, share))).mean() for t in (text() for _ in range(100))])
    apart = np.mean([(walk(text()) == walk(text())).mean() for _ in range(100)])
    assert agree(0) == 1 and agree(0.03) > agree(0.1) > agree(0.2) > apart + 0.1


def test_items_of_several_blocks_and_repeating_characters(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)
    items = ["ab " * 40, "a" * 100, "z" * 30, *(" ".join(f"{w}{k}" for w in "lorem ipsum dolor sit amet consectetur adipiscing elit".split()) for k in range(6))]
    rows = [(k, f"so {t} it is") for k, t in enumerate(items)] + [(90, "a" * 50_000), (91, "ab " * 20_000), (92, "nothing here")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(docs, bench).collect()}
    normal = lambda t: " ".join(re.findall(r"[a-z0-9]+", t))
    want = {(i, j): n for i, t in rows for j, x in enumerate(map(normal, items)) if (n := decontaminate.edit_distance(x, normal(t), len(x) // 5)) <= len(x) // 5}
    assert found == want and (90, 1) in want and (91, 0) in want


# hashes


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n)), "".join("ba"[k.bit_count() % 2] for k in range(n))


def test_texts_built_to_collide(spark):
    """Words that a polynomial modulo 2 ** 64 takes for one another: ids, shingles, removals and counts tell them apart."""
    tokenizer, (x, y) = library("word_bpe_49k.json"), thue_morse(4096)
    rows = [(1, x), (2, y), (3, f"one two three four {x}"), (4, f"one two three four {y}"), (5, f"{x[:1024]} {y[:1024]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dup.near_duplicates(df).collect()} == {1, 2, 3, 4, 5}
    assert by_row(substring_dedup.substring_dedup(df), *COLUMNS) == plain_removal(rows)
    own = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode(pa.array([t for _, t in rows]))
    assert [np.frombuffer(i, "<u4").tolist() for i in own] == [tokenizer.encode(t, add_special_tokens=False).ids for _, t in rows]
    known = {r["doc_id"]: r["n_known"] for r in context_tree.lm_scores(df, F.col("doc_id") == 1).collect()}
    assert known == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1}


def test_words_solved_to_collide(spark):
    """Words of 16 bytes whose second halves were solved for an earlier hash: ids, shingles and counts tell them apart."""
    tokenizer, words_ = library("word_bpe_49k.json"), ["mntyadvy!a!aa!a!", "ipyvafxp[t_zuGfA", "mntyadvy!!!!!&!;", "ipyvafxp[4_:5@&["]
    df = spark.createDataFrame(list(enumerate(words_)), "doc_id long, text string")
    own = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode(pa.array(words_))
    assert [np.frombuffer(i, "<u4").tolist() for i in own] == [tokenizer.encode(t, add_special_tokens=False).ids for t in words_]
    assert {r["component_id"] for r in near_dup.near_duplicates(df).collect()} == {0, 1, 2, 3}
    known = {r["doc_id"]: r["n_known"] for r in context_tree.lm_scores(df, F.col("doc_id") == 1).collect()}
    assert known == {0: 1, 1: 2, 2: 1, 3: 1}


# languages


def test_languages(spark, docs, empty):
    found = language_id.op9_language_id(spark, SF).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    odd = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language_id.language_id(docs).collect()}
    assert odd[0, "und"] == odd[1, "und"] == odd[2, "und"] == 0.0 and all(0 <= s <= 1 for s in odd.values())
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_filter_returns_all_languages_of_an_ngram():
    keys = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f = language_id.Filter([f"l{k}" for k in range(70)], 1 << 16)
    f.add(keys[:1000], 0)
    f.add(keys[500:], 69)
    hits = f.hits(keys, np.zeros(len(keys), np.int64), 1)[0]
    assert hits[0] >= 1000 and hits[69] >= len(keys) - 500 and hits[1] == 0
    assert abs(f.chance()[0] - (hits[0] - 1000) / (len(keys) - 1000)) < 0.01


def test_vote_is_that_of_exact_sets(spark):
    """Sets in place of the filter: every n-gram's languages, looked up one by one."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    held, counts = lambda i: zlib.crc32(str(i).encode()) % 4 == 2, defaultdict(Counter)

    def own_grams(text):
        t = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", (" " + text.lower() + " ").encode())
        return [t[k : k + n] for n in language_id.ORDERS for k in range(len(t) - n + 1)]

    for i, t, lang in rows:
        if t and lang and not held(i):
            counts[lang].update(own_grams(t))
    names, total = sorted(counts), {lang: 0 for lang in counts}
    every = {g for c in counts.values() for g in c if c[g] >= language_id.LEAST}
    for lang in names:
        total[lang] = sum(counts[lang][g] for g in every)
    rate = {g: {lang: counts[lang][g] / total[lang] for lang in names} for g in every}
    owns = {g: {lang for lang in names if counts[lang][g] >= language_id.LEAST and r[lang] >= language_id.SHARE * max(r.values())} for g, r in rate.items()}
    found = {r["doc_id"]: r for r in language_id.op9_language_id(spark, SF).collect()}
    for i, t, _ in rows:
        if language_id.has_letter(t):
            grams = own_grams(t)
            share = {lang: sum(lang in owns.get(g, ()) for g in grams) / len(grams) for lang in names}
            best = max(names, key=lambda x: share[x])
            assert found[i]["lang_pred"] == best or share[best] - share[found[i]["lang_pred"]] < 0.01
            assert abs(found[i]["score"] - share[best]) < 0.01


# language model


def test_language_model(spark, docs, empty):
    texts = real()
    train = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*WORD.findall(t.translate(LOWER)), "END OF TEXT"])
    n, v = sum(train.values()), len(train)
    found = {r["doc_id"]: r for r in context_tree.op10_lm_scores(spark, SF).collect()}
    assert len(found) == len(texts)
    better = []
    for i, t in texts:
        tokens = [*WORD.findall(t.translate(LOWER)), "END OF TEXT"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
        if r["held_out"] and t:
            better.append(r["score"] / len(t.encode()) > -1.2)  # far fewer than the 8 bits of an unknown byte
    assert np.mean(better) > 0.9
    odd = context_tree.lm_scores(docs, F.col("doc_id") > 5).collect()
    assert len(odd) == docs.count() and all(r["score"] < 0 and r["n_tokens"] == 1 for r in odd if r["doc_id"] in (0, 1))
    nothing = [r for r in context_tree.lm_scores(docs, F.lit(False)).collect() if r["doc_id"] == 3]
    assert math.isclose(nothing[0]["score"], -(3 * 9 + 1) * math.log10(2), rel_tol=1e-5)


def plain_tree(texts, depth):
    """The recursion written out: log10 probability of each text under the weighted tree of all texts."""
    bits = lambda c: (1,) if c is None else (0, *(c >> k & 1 for k in range(7, -1, -1)))
    symbols = lambda t: [(bytes(depth) + t)[k : k + depth] for k in range(len(t) + 1)]
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        for context, c in zip(symbols(t), [*t, None], strict=True):
            for d in range(depth + 1):
                for k, bit in enumerate(bits(c)):
                    counts[context[depth - d :], bits(c)[:k]][bit] += 1
    longer = defaultdict(list)
    for context, way in counts:
        if context:
            longer[context[1:], way].append((context, way))

    def estimate(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(node):
        if len(node[0]) == depth:
            return estimate(node)
        return float(np.logaddexp(estimate(node), sum(map(weighted, longer[node])))) - math.log(2)

    def one(context, way, d=0):
        node = (context[depth - d :], way)
        if node not in counts:
            return None
        own = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
        deeper = one(context, way, d + 1) if d < depth else None
        if deeper is None:
            return own
        share = math.exp(estimate(node) - weighted(node)) / 2
        return share * own + (1 - share) * deeper

    def score(t):
        total = 0.0
        for context, c in zip(symbols(t), [*t, None], strict=True):
            for k, bit in enumerate(bits(c)):
                p = one(context, bits(c)[:k])
                p = 0.5 if p is None else p
                total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_scores_are_the_recursion(spark):
    """Every text's score against the recursion by hand, with few and with many strings in the common tables, and in 4 or 1 shards."""
    rng = random.Random(2)
    texts = ["", None, "abracadabra" * 5, "abracadabra", "the rain in spain", "a", "é\x00\x00b", *("".join(rng.choice("abc ") for _ in range(rng.randrange(40))) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for depth, strings in ((2, 1 << 20), (3, 0), (3, 40)):
        want = plain_tree([(t or "").encode() for t in texts[2:30]], depth)
        found = {r["doc_id"]: r["score"] for r in context_tree.lm_scores(df, (F.col("doc_id") >= 2) & (F.col("doc_id") < 30), depth=depth, common_strings=strings, common=strings).collect()}
        assert all(math.isclose(found[k], want((t or "").encode()), rel_tol=1e-4) for k, t in enumerate(texts))


def test_scores_do_not_depend_on_shards(spark):
    def scores():
        return by_row(context_tree.op10_lm_scores(spark, SF).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6).alias("base"), F.round("score", 2).alias("score")), "doc_id", "n_tokens", "n_known", "base", "score")

    few = scores()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert scores() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_probabilities_of_all_symbols_add_up(spark):
    data, at = np.frombuffer(b"abracadabra" * 5, np.uint8), np.array([0, 55])
    for depth in (2, 4):
        strings, counts = np.unique(context_tree.symbol_strings(data, at, depth)[0], return_counts=True)
        upper = context_tree.weighted_levels(strings, counts, context_tree.UPPER, depth)
        below = np.unique(context_tree.shorter(upper[1][0], 1), return_inverse=True)
        levels = [*context_tree.weighted_levels(strings, counts, 0, 1, (below[0], np.bincount(below[1], weights=upper[1][1])))[0], *upper[0]]
        every = strings[5] >> np.uint64(9) << np.uint64(9) | np.arange(257, dtype=np.uint64)
        assert math.isclose((10 ** context_tree.log10_probability(levels, every)).sum(), 1, rel_tol=1e-6)


def test_documents_that_occur_twice_score_higher(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:20]])), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] / len(texts[r["doc_id"] % 60]) for r in context_tree.lm_scores(df, F.lit(True)).collect()}
    assert min(found[k] for k in range(20)) > max(found[k] for k in range(20, 60))


# all of them


def test_empty_tables(spark, empty):
    path = public_tokenizers.path
    for df in (
        near_dup.near_duplicates(empty), substring_dedup.substring_dedup(empty), url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")), packing.pack(empty, path("word_bpe_49k.json")),
        token_count.token_counts(empty, path("byte_bpe_50k.json")), secret_scan.secret_scan(empty), language_id.language_id(empty), context_tree.lm_scores(empty, F.lit(True)),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for file in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in cursor.description].index(c) for c in columns]
    assert sorted(repr(tuple(r[k] for k in at)) for r in cursor.fetchall()) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


