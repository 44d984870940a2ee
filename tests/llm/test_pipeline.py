"""Every stage of the pipeline against a plain version on its own input, and the whole on odd rows."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline as pipeline
from tallygraph.llm import secret_scan
from test_llm_operators import plain_components, plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted((tuple(r[c] for c in pipeline.COLUMNS) for r in df.select(*pipeline.COLUMNS).collect()), key=repr)


def test_language_stage_keeps_running_text(spark, docs):
    kept = pipeline.languages(spark, docs, SF)
    assert kept.columns == list(pipeline.COLUMNS) and kept.count() == docs.filter("text IS NOT NULL AND text <> ''").count()
    odd = docs.unionByName(spark.createDataFrame([(9001, "12345 !!", "en", "s", 8), (9002, None, "en", "s", 0), (9003, "漢字" * 40, None, "s", 80)], docs.schema))
    assert rows(pipeline.languages(spark, odd, SF)) == rows(kept)


def test_near_duplicate_stage_leaves_one_of_each_group(spark, docs):
    kept = {i for i, _, _, k in plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 80) if k}
    assert rows(pipeline.near_duplicates(spark, docs, SF)) == [r for r in rows(docs) if r[0] in kept]


def test_benchmark_stage_drops_leaks_only(spark, docs):
    normal = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    items = [normal(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    clean = [r for r in rows(docs) if not any(x in normal(r[1]) for x in items)]
    assert rows(pipeline.benchmark_free(spark, docs, SF)) == clean


def test_secret_stage_masks_all_spans(spark, docs):
    found = {r[0]: r[1] for r in rows(pipeline.secrets_masked(spark, docs, SF))}
    for r in rows(docs):
        text = list(r[1])
        for start, _, end in plain_spans(r[1])[0]:
            text[start:end] = "*" * (end - start)
        assert found[r[0]] == "".join(text)
    assert secret_scan.findings(secret_scan.scan(pipeline.secrets_masked(spark, docs, SF))).count() == 0


def test_a_second_run_scans_no_blob(spark, docs, tmp_path, monkeypatch):
    """With a ledger that the session names, the query and the stage scan what is new only, and find the same."""
    want = sorted(map(tuple, secret_scan.op7_secret_scan(spark, SF).collect()))
    scanned, scan = [], secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda *a, **b: scanned.append(scan(*a, **b)) or scanned[-1])
    spark.conf.set(secret_scan.LEDGER_PATH, str(tmp_path / "ledger"))
    try:
        assert sorted(map(tuple, secret_scan.op7_secret_scan(spark, SF).collect())) == want
        pairs = secret_scan.read_ledger(spark, str(tmp_path / "ledger")).count()
        assert pairs == len(secret_scan.RULES) * docs.select("text").distinct().count()
        assert sorted(map(tuple, secret_scan.op7_secret_scan(spark, SF).collect())) == want
        masked = rows(pipeline.secrets_masked(spark, docs, SF))
        held = secret_scan.read_ledger(spark, str(tmp_path / "ledger"))
        assert held.count() == pairs  # neither run appended anything
        assert secret_scan.scan(docs, ledger=held).count() == 0
        fresh = docs.limit(3).selectExpr("doc_id", "concat(text, ' password=hunter22') AS text")
        secret_scan.scan_into(fresh, str(tmp_path / "ledger"))
        assert secret_scan.read_ledger(spark, str(tmp_path / "ledger")).count() == pairs + 3 * len(secret_scan.RULES)
    finally:
        spark.conf.unset(secret_scan.LEDGER_PATH)
    assert masked == rows(pipeline.secrets_masked(spark, docs, SF))


def test_packing_stage(spark, docs):
    """Every document's tokens, in order, in gapless sequences; about as few as the tokens need."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pipeline.public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = pipeline.sequences(spark, docs, SF).collect()
    length, bins = {}, {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == length.get(r["doc_id"], 0)
        length[r["doc_id"]] = r["start"] + r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert length == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    for own in bins.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
    assert len(bins) <= 1.25 * sum(length.values()) / 2048 + 1


def test_repeated_ids_keep_their_other_texts(spark, docs):
    """Of one id only the text that is a copy, or holds a passage, goes."""
    words = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree near the river bank at night"
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    other = "an unrelated text about ships and harbours that nobody has copied from anywhere else so far"
    odd = spark.createDataFrame([(3, words, "en", "s", 1), (5, words + " again", "en", "s", 1), (5, other, "en", "s", 1), (7, f"so {item} it is", "en", "s", 1), (7, other + " indeed it is so", "en", "s", 1), (None, item, "en", "s", 1), (None, None, "en", "s", 1)], docs.schema)
    assert sorted((r[0], r[1][:9]) for r in rows(pipeline.near_duplicates(spark, odd.filter("doc_id < 7"), SF))) == [(3, "the quick"), (5, "an unrela")]
    kept = rows(pipeline.benchmark_free(spark, odd, SF))
    assert [(r[0], (r[1] or "")[:9]) for r in kept] == [(3, "the quick"), (5, "an unrela"), (5, "the quick"), (7, "an unrela"), (None, "")]


def test_run(spark, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    out = pipeline.run(spark, SF)
    assert out.filter("offset + length > 2048").count() == 0 and out.select("doc_id").distinct().count() > 100
    full = spark.read.parquet(f"{SF}/documents.parquet")
    full.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_and_extra_columns(spark, docs):
    odd = docs.unionByName(spark.createDataFrame([(None, docs.first()["text"], None, None, None)] * 2, docs.schema)).withColumnRenamed("source", "source").selectExpr("*", "1 AS score", "2 AS found", "3 AS _salt", "4 AS component_id")
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, odd, SF)
        assert out.columns == list(pipeline.COLUMNS), name
        assert out.filter("doc_id IS NULL").count() in (0, 2), name
