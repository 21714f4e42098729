"""The corpus pipeline: documents pass five stages, each written as Parquet before the next reads it.

Quality classifier, exact dedup, near-dedup, mixing to target weights, BPE encoding and decoding. Near-duplicates share 80 % of
their runs of five words; op2 takes runs of four.

Defined results: a null text is empty, and of all empty texts one stays (the mix then takes none of it, as it has no words); a
null doc_id or source is one like any other; of rows that repeat a doc_id and its text one stays, and rows that repeat a doc_id with other
texts are documents of their own; ties go to the smallest doc_id; texts are read whole, however long; further columns are carried to the
last stage, whatever their names; an empty table gives an empty result. No SQL expresses the classifier and the mix, so ORACLE_SQL
is None; tests compare the stages with brute force.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import _base, stages

STAGES = [
    ("quality_classifier", stages.quality_stage),
    ("exact_dedup", stages.exact_stage),
    ("minhash_near_dedup", partial(stages.near_stage, shingle=5)),
    ("source_mixing", stages.mixing_stage),
    ("bpe_encoding", stages.bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, root = _base.table(spark, sf_dir, "documents"), _base.scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = _base.written(stage(spark, docs, sf_dir), f"{root}/{k}_{name}")
    return docs
