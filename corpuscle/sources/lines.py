"""Lines of text files with their numbers.

Files are read in splits, so a task knows the place of a line in its split only. The lines of each split are counted, sums over the
splits before it give its first number (one row a split is all that these sums see), and a line's number is that plus its place in
the split. Texts are read twice and never moved: the table of splits is broadcast up to SPLITS rows, and joined beyond. A split that
was counted in another cut of the files than the one that is read has no row in that table, and raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.sources import readers
from corpuscle.sources.shared import scratch, written

#: Splits whose first numbers are broadcast, at most (24 bytes each); 128 TB of splits of 128 MB.
SPLITS = 1 << 20

#: What a line of a corpus is.
GOOD, EMPTY, BAD, ODD = "good", "empty", "bad", "odd"


def numbered_lines(spark: SparkSession, path: str, broadcast: int = SPLITS) -> DataFrame:
    """file (its path), line_num (from 0) and value of every line below path; lines end as in Python, at \\n, \\r or both."""
    place = F.monotonically_increasing_id().alias("_place")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), place)
    split = [F.xxhash64("file").alias("_file"), F.col("_start"), F.shiftright("_place", 33).alias("_task")]
    lines = lines.select("*", split[0], split[2])
    found = lines.groupBy("_file", "_start", "_task").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    found = written(found, f"{scratch(spark)}/splits")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = found.select("_file", "_start", "_task", (before - F.col("_first")).alias("_shift"))
    if found.count() <= broadcast:
        starts = F.broadcast(starts)
    number = F.coalesce(F.col("_shift"), F.raise_error(F.lit("the files were cut into other splits when their lines were counted"))) + F.col("_place")
    return lines.join(starts, ["_file", "_start", "_task"], "left").select("file", number.alias("line_num"), "value")


def line_kind(value: Column, body: Column) -> Column:
    """good; empty: no text in `body`; bad: no JSON value, such as a blank line, or more than one; odd: JSON, but no object."""
    one = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    none = one.isNull() | F.try_variant_get(one, "$[0]", "variant").isNull() | F.try_variant_get(one, "$[1]", "variant").isNotNull()
    known = F.when(none, BAD).when(~F.startswith(F.ltrim(value), F.lit("{")), ODD)
    return known.when(F.coalesce(body, F.lit("")) == "", EMPTY).otherwise(GOOD)


def numbered_corpus(spark: SparkSession, path: str, schema: T.StructType = readers.FUNCTION, body: str = "func_def") -> DataFrame:
    """file, line_num (from 0), kind, and the fields of every line; those of a line that is no JSON object are null. NaN and infinities
    are no JSON here."""
    lines = numbered_lines(spark, path)
    parsed = lines.select("file", "line_num", "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}).alias("r"))
    kind = line_kind(F.col("value"), F.col(f"r.{body}"))
    rows = parsed.select("file", "line_num", kind.alias("kind"), "r")
    return rows.select("file", "line_num", "kind", *(F.when(F.col("kind").isin(GOOD, EMPTY), F.col(f"r.{n}")).alias(n) for n in schema.names))


def line_message(kind: Column, line_num: Column, body: str = "func_def") -> Column:
    """What is told of a line, by its number from 1; null of a good one."""
    n = (line_num + 1).cast("string")
    told = F.when(kind == BAD, F.concat(F.lit("Error parsing JSON on line "), n)).when(kind == ODD, F.concat(F.lit("Error processing line "), n))
    return told.when(kind == EMPTY, F.concat(F.lit(f"Warning: Empty '{body}' on line "), n))


def line_counts(rows: DataFrame) -> DataFrame:
    """By file: lines, and how many of each kind."""
    return rows.groupBy("file").agg(F.count("*").alias("n_lines"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (GOOD, EMPTY, BAD, ODD)))


def metadata_index(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last line of each key by file and number, with line_num from 0; lines without a key are left out. Partial maxima, so a key
    that very many lines have is no hot task."""
    known = rows.where(F.col(key).isNotNull() & F.col("kind").isin(GOOD, EMPTY)).withColumn("_at", F.struct("file", "line_num"))
    return readers.last_by(known, key, "_at").drop("_at")
