"""One text document made by many tasks from rows in order: JSON arrays and nested JSON reports.

Rows are dealt by ranges of their order and sorted within them. Each row's fragment follows from the row and the one before it; the
last row of each range is told to the next one (one row a range). The bytes of each range are counted, so every task knows where its
fragments begin in the file, and writes them there. No task and not the driver holds the document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import ship
from corpuscle.sources.named_files import write_pieces
from corpuscle.sources.shared import scratch, written

Fragment = Callable[[dict | None, dict], str]


def write_document(rows: DataFrame, order: list[str], fragment: Fragment, closing: Callable[[dict | None], str], folder: str, name: str) -> None:
    """folder/name: the fragments (of the row before, or None, and the row) in order, and the closing of the last row, or None."""
    spark, root, columns = rows.sparkSession, scratch(rows.sparkSession), rows.columns
    ship(spark)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), f"{root}/rows")
    last = table.groupBy("_part").agg(F.max_by(F.struct(*columns), "_place").alias("r")).orderBy("_part").toArrow().to_pylist()  # one row a range
    before = {b["_part"]: a["r"] for a, b in zip(last, last[1:], strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, previous, at = None, None, 0
        for b in batches:
            out: dict[tuple[int, int], list[bytes]] = {}
            for row in b.to_pylist():
                now = row.pop("_part")
                row.pop("_place")
                if now != part:
                    part, previous, at = now, before.get(now), 0
                    key = (part, at)
                elif not out:
                    key = (part, at)
                text = fragment(previous, row).encode()
                out.setdefault(key, []).append(text)
                at, previous = at + len(text), row
            content = [b"".join(c) for c in out.values()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([a for _, a in out], pa.int64()), pa.array(content, pa.binary())], ["part", "at", "content"])

    sorted_again = table.repartition("_part").sortWithinPartitions("_part", "_place")
    pieces = written(sorted_again.mapInArrow(run, "part int, at long, content binary"), f"{root}/pieces")
    starts, total = [], 0
    for r in pieces.groupBy("part").agg(F.sum(F.octet_length("content")).cast("long").alias("n")).orderBy("part").collect():  # one row a range
        starts.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(starts, "part int, start long")
    placed = pieces.join(F.broadcast(starts), "part").select(F.lit(name).alias("path"), (F.col("start") + F.col("at")).alias("offset"), "content")
    end = spark.createDataFrame([(name, total, closing(last[-1]["r"] if last else None).encode())], "path string, offset long, content binary")
    write_pieces(placed.unionByName(end), folder)


def _indented(value: object, depth: int) -> str:
    return json.dumps(value, indent=2).replace("\n", "\n" + "  " * depth)


def _entry(before: dict | None, row: dict) -> str:
    return ("[\n  " if before is None else ",\n  ") + _indented(row, 1)


def write_json_array(rows: DataFrame, order: list[str], folder: str, name: str) -> None:
    """A JSON array of the rows in their order, as json.dumps(rows, indent=2) writes it."""
    write_document(rows, order, _entry, lambda last: "[]" if last is None else "\n]", folder, name)


def _level(before: dict | None, row: dict, levels: list[str], values: list[str]) -> str:
    depth = len(levels)
    new = next((i for i, x in enumerate(levels) if before is None or before[x] != row[x]), depth)
    if new == depth:
        raise ValueError(f"two rows of {[row[x] for x in levels]}")
    out = "{" if before is None else "".join("\n" + "  " * (i + 1) + "}" for i in range(depth - 1, new - 1, -1)) + ","
    key = lambda k: json.dumps({k: None})[1:-7]
    out += "".join("\n" + "  " * (i + 1) + f"{key(row[levels[i]])}: {{" for i in range(new, depth))
    margin = "\n" + "  " * (depth + 1)
    return out + ",".join(f"{margin}{key(v)}: {_indented(row[v], depth + 1)}" for v in values)


def write_nested_report(stats: DataFrame, levels: list[str], values: list[str], folder: str, name: str) -> None:
    """Objects within objects, keyed by the levels, that hold the values (one or more): as json.dumps(report, indent=2) writes a report
    whose keys are in order. Two rows of the same levels raise."""
    closing = lambda last: "{}" if last is None else "".join("\n" + "  " * (i + 1) + "}" for i in range(len(levels) - 1, -1, -1)) + "\n}"
    write_document(stats.select(*levels, *values), levels, partial(_level, levels=levels, values=values), closing, folder, name)
