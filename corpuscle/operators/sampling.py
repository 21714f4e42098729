"""Difficulty buckets and samples of at most `cap` rows of each."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.distribution import global_index
from corpuscle.sources.shared import scratch, written

CAP, SEED = 25, 42


def in_range(difficulty: Column, low: float = 1.0, high: float = 75.0) -> Column:
    return difficulty.between(low, high)


def hash_sample(rows: DataFrame, bucket: str, key: str, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Rows with the `cap` smallest hashes of each bucket. The rank limit is pushed below the exchange, so a hot bucket sends at
    most `cap` rows a task."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(order, key))
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def exact_sample(rows: DataFrame, bucket: str, order: str, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows that random.sample with one seeded generator takes, buckets ascending, rows by `order`. The generator depends on
    the buckets' sizes only, so the driver needs these (one row a bucket) and nothing else; the places that it draws, at most
    `cap` a bucket, come back as a broadcast table. Rows are written once, as sizes, ranges and places are all taken from them."""
    rows = written(rows, f"{scratch(rows.sparkSession)}/rows")
    sizes = {r[bucket]: r["n"] for r in rows.groupBy(bucket).agg(F.count("*").alias("n")).collect()}
    generator, drawn, before = random.Random(seed), [], 0
    for b in sorted(sizes):
        n = sizes[b]
        places = range(n) if n < cap else generator.sample(range(n), cap)
        drawn += [(before + p, p, i) for i, p in enumerate(places)]
        before += n
    picks = rows.sparkSession.createDataFrame(drawn, "index long, position long, output_order long")
    # places over all buckets in order, so that a hot bucket spreads over many ranges
    return global_index(rows, bucket, order).join(F.broadcast(picks), "index").drop("index")  # at most cap rows a bucket


def bucket_stats(rows: DataFrame, bucket: str, cap: int = CAP) -> DataFrame:
    """total, selected and percentage of each bucket, in one pass: a sample takes `cap` rows of a bucket, or all if there are fewer."""
    out = rows.groupBy(bucket).agg(F.count("*").alias("total")).withColumn("selected", F.least("total", F.lit(cap).cast("long")))
    return out.withColumn("percentage", F.round(F.col("selected") / F.col("total") * 100, 4))


def largest_buckets(stats: DataFrame, bucket: str, k: int = 20) -> DataFrame:
    return stats.orderBy(F.desc("total"), bucket).limit(k)
