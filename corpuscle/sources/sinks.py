"""Sinks: JSON lines, partitioned trees, files of labels, text reports. Arrays and nested reports: `documents`; files by name: `named_files`."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.named_files import write_files
from corpuscle.sources.packed_files import write_packed


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_label_files(labelled: DataFrame, root: str, levels: list[str], name: str = "file", content: str = "content", *, packed: bool = False) -> None:
    """A copy of each document for each of its labels, under its own name below folders of the levels; what was at root before goes. A
    slash in a value is written as _. packed: as members of archives, for trees of very many small files."""
    parts = [F.translate(F.col(c).cast("string"), "/", "_") for c in (*levels, name)]
    write = write_packed if packed else write_files
    write(labelled.select(F.concat_ws("/", *parts).alias("path"), F.col(content).alias("content")), root)


def write_tree(labelled: DataFrame, path: str, levels: list[str]) -> None:
    """Rows below folders of the levels, for trees of any size; what was there before goes."""
    dealt = labelled.hint("rebalance", *levels)  # few writers a folder; adaptive execution splits a folder with very many rows
    dealt.write.mode("overwrite").partitionBy(*levels).parquet(path)


def error_log(head: list[str], errors: DataFrame, counts: dict[str, Column], trailer: list[str]) -> DataFrame:
    """Lines of an error log (part, place, value): head, the messages of `errors` (place, message) in their order, and a summary whose
    lines name `counts` (aggregates of `errors`) as in "%(n)d"."""
    spark = errors.sparkSession
    first = spark.createDataFrame([(0, i, line) for i, line in enumerate(head)], "part int, place long, value string")
    lines = errors.where("message is not null").select(F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), F.col("message").alias("value"))
    whole = errors.agg(*(c.alias(name) for name, c in counts.items()))
    line = lambda given: F.format_string(re.sub(r"%\(\w+\)", "%", given), *map(F.col, re.findall(r"%\((\w+)\)", given)))
    rows = [F.struct(F.lit(i).cast("long").alias("place"), line(given).alias("value")) for i, given in enumerate(trailer)]
    last = whole.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(2).alias("part"), "r.place", "r.value")
    return first.unionByName(lines).unionByName(last)


def write_log(lines: DataFrame, path: str) -> None:
    """Log lines (part, place, value) as text in their order."""
    lines.orderBy("part", "place").select("value").write.mode("overwrite").text(path)
