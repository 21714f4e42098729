"""The pipeline's stages against what the operators say of their input, on the smallest tables."""

import hashlib
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from corpuscle.llm import bpe, mixing, quality, stages
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_keeps_clean_documents(spark, docs):
    kept = stages.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in ids for i in good) >= 0.9 * len(good)
    assert sum(i not in ids for i in bad) >= 0.6 * len(bad)


def test_quality_stage_by_scores(spark, docs):
    """The rows that stay are those whose score, text by text, reaches the threshold."""
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = quality.Scorer(model)
    want = sorted((r["doc_id"], r["text"]) for r in docs.collect() if scorer.score(r["text"]) >= quality.THRESHOLD)
    assert 0 < len(want) < docs.count()
    assert sorted((r["doc_id"], r["text"]) for r in stages.quality_stage(spark, docs, SF).collect()) == want


def test_mixing_stage_by_copies(spark, docs):
    """Every document comes as often as the mix takes it."""
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, whole=True).collect()}
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in stages.mixing_stage(spark, docs, SF).collect())
    assert got == Counter({(r["doc_id"], r["text"], r["source"]): int(copies[r["doc_id"]]) for r in docs.collect() if copies[r["doc_id"]]})


def test_exact_stage(spark, docs):
    got = sorted(r["doc_id"] for r in stages.exact_stage(spark, docs.unionByName(docs.limit(3)), SF).collect())
    best = {}
    for r in docs.collect():
        key = WS.sub("", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    assert got == sorted(d for _, d in best.values())


def test_near_stage(spark, docs):
    got = sorted(r["doc_id"] for r in stages.near_stage(spark, docs, SF).collect())
    assert got == sorted(d for d, _, _, kept in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if kept)


def test_mixing_stage(spark, docs):
    got = stages.mixing_stage(spark, docs, SF)
    assert got.columns == docs.columns
    times = Counter(r["doc_id"] for r in got.collect())
    assert max(times.values()) <= 2
    assert times == Counter(r["doc_id"] for r in stages.mixing_stage(spark, docs, SF).collect())
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    total, taken = words(docs.collect()), words(got.collect())
    longest = max(len(r["text"].split()) for r in docs.collect())
    assert abs(taken - 1.5 * total) <= 20 * longest


def test_bpe_stage(spark, docs):
    own = bpe.encoder(bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in stages.bpe_stage(spark, docs, SF).collect():
        assert r["ids"] == own.tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_whole_run(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert out.count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:  # each on what the one before it kept
        kept = stage(spark, docs, SF)
        assert 0 < kept.count() and kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in docs.collect())
    for r in out.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_pipeline_edges(spark, folder):
    """Nulls, empty and repeated rows, one row, and no rows."""
    import corpus_pipeline

    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "w x y z u v"), (5, "long " * 3000)]
    for given in (rows, rows[2:3], []):
        d = folder(given, source=[None] * len(given), labels=[])
        out = corpus_pipeline.run(spark, d).collect()
        assert {r["doc_id"] for r in out} <= {i for i, _ in given}
        if given == rows:
            assert {3, None, 5} <= {r["doc_id"] for r in out}
