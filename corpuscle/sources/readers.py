"""Readers of the artifacts: JSON lines, JSON arrays, outcome trees, logs, pipe-delimited event logs, configuration files."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.text import strip
from corpuscle.session import ship
from corpuscle.sources import named_files

#: A corpus function; test inputs and outputs keep their JSON text, as their shapes differ by row.
FUNCTION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in ("fname", "func_def", "func_head", "func_head_types", "real_deps", "real_exe_wrapper")),
        T.StructField("real_io_pairs", T.ArrayType(T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType())]))),
    ]
)
ADDRESS_MAP = "name string, addr string"
#: Fields of an event log line.
LOG_FIELDS = ["status", "type", "file", "relative_path", "timestamp", "details"]
#: Integers as the scripts' int() takes them: a sign, underscores between digits, white space around; digits of any script.
NUMERIC_STEM = r"^[+-]?[0-9]+(_[0-9]+)*$"
#: Decimal digits of other scripts than ASCII, and the digits that they stand for.
OTHER_DIGITS = "".join(chr(c) for c in range(128, 0x110000) if unicodedata.decimal(chr(c), None) is not None)
THEIR_DIGITS = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = FUNCTION) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a bad line is a row with its text in `_corrupt`."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("r")).select("r.*")


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt is null").drop("_corrupt")


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType = FUNCTION) -> DataFrame:
    """A bad line raises; the column asm is dropped, which the scan then doesn't parse."""
    return spark.read.schema(T.StructType([f for f in schema.fields if f.name != "asm"])).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str = ADDRESS_MAP) -> DataFrame | None:
    """The entries of one JSON array. A missing or an invalid file is no map: None, and the caller leaves out what needs it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), "value")
    if whole.where("v is null").count() or whole.isEmpty():
        return None
    return whole.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows without one are ignored. Partial maxima, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("r")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "r.*")


def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: raw.decode("utf-8", "ignore"), na_action="ignore")


def valid_text(content: Column) -> Column:
    """Bytes as text, without those that are no UTF-8. Only contents that have such bytes go to Python; a U+FFFD that stands there stays."""
    text = content.cast("string")
    decoded = F.pandas_udf(_decoded, T.StringType())
    return F.when(F.is_valid_utf8(text), text).otherwise(decoded(F.when(~F.is_valid_utf8(text), content)))


def _scanned(files: DataFrame) -> DataFrame:
    """path and length of a scan of binary files, with empty ones, which Spark's scans leave out. The driver holds the names."""
    names = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    full = files.select("path", "length")
    empty = files.sparkSession.createDataFrame(names, "path string").join(full, "path", "left_anti")
    return full.unionByName(empty.withColumn("length", F.lit(0).cast("long")))


def _whole(spark: SparkSession, root: str, suffix: str = "", *, levels: int | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """path and content of whole files below root, empty ones too, byte for byte but for bytes that are no UTF-8, which are left out.
    levels: only files that many levels below root. keep: a condition on the path, for which contents are not read.

    Executors list a folder and read its files. What they cannot list, such as a pattern, is Spark's scan, whose names the driver holds."""
    kept = keep or (lambda path: F.lit(True))  # noqa: ARG005
    if named_files.reachable(root):
        files = named_files.list_files(spark, root).where(F.endswith("source", F.lit(suffix)) & kept(F.col("source")))
        if levels:
            files = files.where(F.size(F.split("relative", "/")) == levels)
        return named_files.read_files(files, text=True)
    ship(spark)
    path = root + "/*" * (levels - 1) if levels else root
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", not levels).load(path)
    empty = _scanned(files).where("length = 0").select("path", F.lit("").alias("content"))
    return files.select("path", valid_text(F.col("content")).alias("content")).unionByName(empty).where(kept(F.col("path")))


def read_tree(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """root/iteration/model/ir/opt/*suffix: path parts as columns, and content."""
    parts = F.split("path", "/")
    names = ("iteration", "model", "ir", "opt", "file")
    return _whole(spark, root, suffix, levels=5).select(*(F.element_at(parts, i - 5).alias(n) for i, n in enumerate(names)), "content")


def read_numeric_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files anywhere below root whose stem is an integer: relative_path, id, content."""
    stem = lambda path: F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)
    rows = _whole(spark, root, suffix, keep=lambda path: integer(stem(path)).isNotNull())
    return rows.withColumn("stem", stem(F.col("path"))).withColumn("id", integer(F.col("stem")))


def integer(stem: Column) -> Column:
    """The integer that a stem spells; null of others, and of those beyond 64 bits."""
    plain = F.translate(strip(stem), OTHER_DIGITS, THEIR_DIGITS)
    return F.when(plain.rlike(NUMERIC_STEM), F.regexp_replace(plain, "[_+]", "").try_cast("long"))


def read_representations(spark: SparkSession, root: str) -> DataFrame:
    """All files of the four representations, by lower-cased extension."""
    ir = lambda path: F.substring(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)), 2, 10)
    return _whole(spark, root, keep=lambda path: ir(path).isin("asm", "llil", "mlil", "hlil")).select("path", ir(F.col("path")).alias("ir"), "content")


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """identifier (file stem) and content of every .log below root."""
    return _whole(spark, root, ".log").select(F.regexp_extract("path", r"([^/]*)\.log$", 1).alias("identifier"), "content")


def list_binaries(spark: SparkSession, root: str, *, hidden: bool = True) -> DataFrame:
    """path and length of every file below root, empty ones too; the contents are not read."""
    if named_files.reachable(root):
        files = named_files.list_files(spark, root).select(F.col("source").alias("path"), "length")
    else:
        files = _scanned(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    return files if hidden else files.where(~F.col("path").rlike(r"/\.[^/]*$"))


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of event log lines; comments, blank lines and the summary are left out, details may hold the separator."""
    c = F.col(column)
    rows = lines.where((F.trim(c) != "") & ~F.startswith(c, F.lit("#")) & F.contains(c, F.lit("|")))
    parts = F.split(c, r"\|", len(LOG_FIELDS))
    return rows.select(*(F.get(parts, i).alias(n) for i, n in enumerate(LOG_FIELDS)))


class Config(dict):
    """KEY=VALUE lines; comments and blank lines are skipped, quotes around a value go. A missing key is None."""

    def __init__(self, path: str):
        super().__init__()
        for line in Path(path).read_text().splitlines():
            line = line.strip()
            if line and not line.startswith("#"):
                if "=" not in line:
                    raise ValueError(f"no '=' in {line!r}")
                key, _, value = line.partition("=")
                self[key.strip()] = value.strip().strip('"').strip("'")

    def __missing__(self, key: str) -> None:
        return None
