"""Pipeline stages over nulls, empty and repeated rows, an empty table, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import stages

ROWS = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a  b c d e f"), (5, "long " * 30_000), (6, "x y"), (7, "x y")]
STAGES = [stages.quality_stage, stages.exact_stage, stages.near_stage, stages.mixing_stage]
CLASHING = ["_doc_id", "_text_key", "__doc_id", "_copy", "_times", "_rows", "_gone", "_doc", "times", "copy", "k", "group", "less", "score", "kept", "component_id", "n_tokens", "ids", "parts", "digest", "text_key", "Class"]


@pytest.mark.parametrize("stage", STAGES)
def test_columns_stay_and_nothing_fails(spark, folder, stage):
    for rows in (ROWS, []):
        d = folder(rows, source=["s"] * len(rows), labels=[(3, 1)][: len(rows)])
        docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("digest", "score").withColumnRenamed("size", "kept").withColumnRenamed("spans", "component_id")
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        got = out.collect()
        assert rows or got == []
        assert {r["doc_id"] for r in got} <= {i for i, _ in rows}


def test_one_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(folder(ROWS) + "/documents.parquet")
    exact = sorted(r["doc_id"] for r in stages.exact_stage(spark, docs, "").collect())
    assert exact == [1, 4, 5, 6]  # null and empty are one text, the one with most code points stays
    near = sorted(r["doc_id"] for r in stages.near_stage(spark, docs, "").collect())
    assert near == [1, 2, 3, 5, 6]  # documents without words link with nothing
    coded = stages.bpe_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in coded) == [1, 2, 3, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("stage", [*STAGES, stages.bpe_stage])
def test_clashing_columns(spark, folder, stage):
    d = folder(ROWS, source=["s"] * len(ROWS), labels=[(3, 1), (6, 0)])
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source", *(F.lit(c).alias(c) for c in CLASHING))
    out = stage(spark, docs, d)
    if stage is not stages.bpe_stage:
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHING)
    assert stage(spark, docs.limit(0), d).collect() == []


@pytest.mark.parametrize("stage", [stages.exact_stage, stages.near_stage])
def test_rows_that_the_operator_keeps_stay(spark, folder, stage):
    t, unique = "a b c d e f g", "quite other words than those"
    rows = [(1, t), (3, t), (3, unique), (None, "one without a name but words"), (5, t), (None, t)]
    got = stage(spark, spark.read.parquet(folder(rows) + "/documents.parquet"), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, t), (3, unique), (None, "one without a name but words")], key=str)


@pytest.mark.parametrize("stage", [stages.exact_stage, stages.near_stage])
def test_one_of_equal_rows_stays(spark, folder, stage):
    rows = [(2, "a b c d e f")] * 3 + [(2, "a  b c d e f"), (9, "a b c d e f")]
    got = stage(spark, spark.read.parquet(folder(rows) + "/documents.parquet"), "").select("doc_id", "text").collect()
    assert len(got) == 1 and got[0]["doc_id"] == 2


def test_mix_of_repeated_rows(spark, folder):
    rows = [(1, "a b c d")] * 40 + [(1, "e f g h"), (None, "i j k l")]
    docs = spark.read.parquet(folder(rows, source=["s"] * 42) + "/documents.parquet")
    out = stages.mixing_stage(spark, docs, "").collect()
    assert len(out) == 63  # 1.5 times as many rows, of one size
    assert 1 <= sum(r["text"] == "e f g h" for r in out) <= 2
