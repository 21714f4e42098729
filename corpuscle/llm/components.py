"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import _base


def _least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least neighbour of u or u itself. Sums by u are partial first, and a hub's edges are split by adaptive joins."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _least(large)
    return small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, root: str) -> DataFrame:
    """node and root (its component's least node) of every node that is not itself a root. edges: u, v, longs. Each round is
    written below `root`, so its lineage ends there."""
    spark = edges.sparkSession
    now = _base.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{root}/round0")
    state, i = None, 0
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not found["n"] or (found["n"], found["h"]) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, i = (found["n"], found["h"]), i + 1
        now = _base.written(_round(now), f"{root}/round{i}")
        if i > 1:
            _base.remove(spark, f"{root}/round{i - 2}")
