"""The operators as stages of a corpus pipeline: each takes documents and returns the documents that its decisions leave.

A row is known by its doc_id and a hash of its text, so rows that repeat a doc_id with other texts are judged one by one, and a
null doc_id is one like any other. Of rows that repeat both, the dedup stages keep one if it has a group (documents without
words, which link with nothing, all stay in near_stage); the mix takes such rows alike. Null and empty texts pass by each
operator's own rules; an empty table stays empty; further columns are carried whatever their names. A stage prepares the session
that it is given (session.prepare).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base, bpe, exact_dedup, mixing, near_dedup, quality, sieve


def _stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str, **more: object) -> DataFrame:
        _base.prepare(spark)
        return f(spark, docs, sf_dir, **more)

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return quality.keep_good(docs, quality.learn(docs, _base.table(spark, sf_dir, "labels")))


def _row(docs: DataFrame) -> tuple[Column, Column]:
    """What a row is known by: doc_id, and the hash of the text that the operators give as text_key."""
    return docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _named(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, Column]:
    """rows (doc_id, text_key, ...) with names that docs does not have, and the condition that a row of docs is one of them."""
    names = _base.fresh(docs, *rows.columns)
    own = rows.toDF(*names)
    doc, text = _row(docs)
    at = dict(zip(rows.columns, names, strict=True))
    return own, doc.eqNullSafe(own[at["doc_id"]]) & (text == own[at["text_key"]])


def _left(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One document of each group. rows: doc_id, text_key, group (null for a row that has none beside it), kept, less (the least of
    kept rows stays). Only suspects move: those that go, and those that repeat what stays."""
    root = _base.scratch(docs.sparkSession)
    rows = _base.written(rows, f"{root}/rows")
    own = rows.where("kept and group is not null")
    best = own.groupBy("group").agg(F.count("*").alias("c"), F.min(F.struct("less", "text_key")).alias("m")).where("c > 1")
    best = _base.written(best.select("group", F.col("m.text_key").alias("stays")), f"{root}/best")
    twice = own.join(best, "group")
    gone = rows.where("not kept").select("doc_id", "text_key").unionByName(twice.where("text_key <> stays").select("doc_id", "text_key")).distinct()
    gone = _base.written(gone, f"{root}/gone")
    same = twice.where("text_key = stays").groupBy("doc_id", "text_key").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "text_key")
    same = _base.written(same, f"{root}/same")
    suspects = gone.unionByName(same).select(F.xxhash64("doc_id", "text_key").alias("k"))
    maybe, clear = sieve.split(docs, F.xxhash64(*_row(docs)), sieve.build(suspects))
    out, is_gone = _named(maybe, gone)
    maybe = maybe.join(out, is_gone, "left_anti")
    if not same.isEmpty():
        again, is_same = _named(maybe, same)
        repeated = maybe.join(again, is_same, "left_semi").dropDuplicates(["doc_id", "text"])
        maybe = maybe.join(again, is_same, "left_anti").unionByName(repeated)
    return clear.unionByName(maybe)


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = exact_dedup.exact_dedup(docs)
    group = F.when(F.col("group_size") > 1, F.struct("keep_id", "text_sha256"))
    return _left(docs, found.select("doc_id", "text_key", group.alias("group"), "kept", (-F.col("n_cp")).alias("less")))


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, shingle: int = near_dedup.SHINGLE) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of so many words."""
    found = near_dedup.near_duplicates(docs, shingle)
    return _left(docs, found.select("doc_id", "text_key", "group", "kept", F.lit(0).alias("less")))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; whole documents only. Rows that repeat doc_id, text and source come as often as
    all of them are taken."""
    mixed = mixing.mix(docs, whole=True).groupBy("doc_id", "text_key", "source").agg(F.sum("copies").cast("int").alias("times"), F.count("*").alias("rows"))
    mixed = _base.written(mixed.where("times > 0"), f"{_base.scratch(spark)}/copies")

    def taken(given: DataFrame, counts: DataFrame) -> DataFrame:
        own, is_taken = _named(given, counts)
        source, times, copy = own.columns[2], own.columns[3], *_base.fresh(given, "copy")
        met = given.join(own, is_taken & given["source"].cast("string").eqNullSafe(own[source]))
        return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))

    out = taken(docs, mixed.where("rows = 1"))
    repeated = mixed.where("rows > 1")
    if repeated.isEmpty():
        return out
    own, is_repeated = _named(docs, repeated)
    once = docs.join(own, is_repeated, "left_semi").dropDuplicates(["doc_id", "text", "source"])
    return out.unionByName(taken(once, repeated))


@_stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the decoded text."""
    return bpe.encode_and_decode(docs).select("doc_id", "n_tokens", "ids", "decoded_sha256")
