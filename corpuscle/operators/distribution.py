"""Contiguous shares of sorted work, and the merge of what workers made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.sources.named_files import PIECE, deal, list_files, read_pieces, write_pieces
from corpuscle.sources.shared import exists, scratch, written


def global_index(rows: DataFrame, *order: str) -> DataFrame:
    """Adds index, the 0-based place of each row in the order, without one task that sees all rows: rows are dealt by ranges and
    sorted within them, and the counts of the ranges before are added."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), scratch(spark))
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a range
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    before = spark.createDataFrame(starts, "_part int, _start long")
    return dealt.join(F.broadcast(before), "_part").withColumn("index", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def shares(rows: DataFrame, path: str, n: int) -> DataFrame:
    """Adds worker (1 to n): contiguous shares of the rows by path, the first ones longer by one where n doesn't divide them.
    Paths sort by their parts."""
    parts = rows.withColumn("_parts", F.split(path, "/"))
    placed = global_index(parts, "_parts", path).drop("_parts")
    total = placed.count()
    small, longer = divmod(total, n)
    cut = longer * (small + 1)
    worker = F.when(F.col("index") < cut, F.floor(F.col("index") / (small + 1)) + 1)
    if small:
        worker = worker.otherwise(longer + F.floor((F.col("index") - cut) / small) + 1)
    return placed.withColumn("worker", worker.cast("int"))


def merge_outputs(outputs: DataFrame) -> DataFrame:
    """One file per path: the contents of all workers (path, worker, content) in the workers' order. Takes as many rows of a path
    to one task as there are workers."""
    held = F.array_sort(F.collect_list(F.struct("worker", "content")))
    return outputs.groupBy("path").agg(held.alias("h")).select("path", F.array_join(F.transform("h", lambda x: x["content"]), "").alias("content"), F.size("h").alias("n_workers"))


#: What a merge does with a path that is there before: append without a word, or tell of it (what was there first is copied).
APPEND, REPORT = "append", "report"


def merge_trees(spark: SparkSession, source: str, target: str, rule: str = REPORT, piece: int = PIECE) -> DataFrame:
    """Files below source/worker/ as bytes, put together by their paths below target: what target has before, then the workers' in the
    order of their names. Gives what is told of conflicts (path, worker, message), one row for each file that finds its path taken;
    none by the rule `append`. A second run appends everything again, as the scripts do.

    Offsets are sums over the workers of a path (one row each). Files are read and written in pieces, dealt by ranges of path and
    offset, so neither a large file nor a path with many workers is one task's work."""
    files = list_files(spark, source).where(F.contains("relative", F.lit("/")))
    parts = files.select(F.substring_index("relative", "/", 1).alias("worker"), F.expr("substring(relative, instr(relative, '/') + 1)").alias("path"), "source", "length")
    if exists(spark, target):
        parts = parts.unionByName(list_files(spark, target).select(F.lit(None).cast("string").alias("worker"), F.col("relative").alias("path"), "source", "length"))
    before = Window.partitionBy("path").orderBy(F.col("worker").asc_nulls_first())  # one row a worker
    start = F.coalesce(F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(parts.select("*", start.alias("start"), F.row_number().over(before).alias("place")), f"{scratch(spark)}/parts")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(piece).cast("long")))
    pieces = placed.select("path", "source", "start", "length", steps.alias("source_offset"))
    pieces = pieces.select("path", "source", "source_offset", (F.col("start") + F.col("source_offset")).alias("offset"), F.least(F.lit(piece), F.col("length") - F.col("source_offset")).cast("long").alias("n"))
    write_pieces(read_pieces(deal(pieces, target)), target, dealt=True)
    told = F.format_string("CONFLICT: File '%s' already exists. Appending content from '%s/%s/%s'", "path", F.lit(source.rstrip("/")), "worker", "path")
    return placed.where((F.col("place") > 1) & F.lit(rule == REPORT)).select("path", "worker", told.alias("message"))
