"""Joins of function maps, logs, metadata and sources, each with its counts of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import address
from corpuscle.operators.distribution import global_index

OPT_LEVELS = ["O0", "O1", "O2", "O3"]
REPRESENTATIONS = ["asm", "hlil", "llil", "mlil"]

# Messages of lines that can't be built.
UNREADABLE = "Error parsing JSON at line %s: %s"
NO_ID = "Line %s: 'id' field not found"
NO_DEFINITION = "Line %s (ID=%s): func_def not found"


def usable(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Functions whose address has a file."""
    return functions.join(files.select("addr").distinct(), "addr", "left_semi")


def unusable(functions: DataFrame, files: DataFrame) -> DataFrame:
    return functions.join(files.select("addr").distinct(), "addr", "left_anti")


def verdict(content: Column) -> Column:
    """FAILED anywhere beats SUCCESS; neither gives null."""
    return F.when(F.contains(content, F.lit("FAILED")), "failed").when(F.contains(content, F.lit("SUCCESS")), "passed")


def log_verdicts(logs: DataFrame) -> DataFrame:
    """identifier and its verdict; logs without one are dropped, failed wins within an identifier."""
    rows = logs.select("identifier", verdict(F.col("content")).alias("verdict")).where("verdict is not null")
    return rows.groupBy("identifier").agg(F.min("verdict").alias("verdict"))


def classify_coverage(functions: DataFrame, logs: DataFrame) -> DataFrame:
    """Adds coverage: a function whose mutant fails the suite is covered, one whose mutant passes is uncovered, others are
    missing. The log is looked up by address as it is, then without 0x."""
    found = log_verdicts(logs)
    exact = found.select(F.col("identifier").alias("addr"), F.col("verdict").alias("_exact"))
    bare = found.select(F.col("identifier").alias("_bare"), F.col("verdict").alias("_second"))
    out = functions.withColumn("_bare", F.replace("addr", F.lit("0x"), F.lit(""))).join(exact, "addr", "left").join(bare, "_bare", "left")
    v = F.coalesce("_exact", "_second")
    return out.withColumn("coverage", F.when(v == "failed", "covered").when(v == "passed", "uncovered").otherwise("missing")).drop("_exact", "_second", "_bare")


def with_code(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Functions with their file's content, by address as it is or without 0x; null where there is none."""
    once = files.groupBy("addr").agg(F.max("content").alias("content"))
    exact = once.select("addr", F.col("content").alias("_exact"))
    bare = once.select(F.col("addr").alias("_bare"), F.col("content").alias("_second"))
    out = functions.withColumn("_bare", F.replace("addr", F.lit("0x"), F.lit(""))).join(exact, "addr", "left").join(bare, "_bare", "left")
    return out.withColumn("content", F.coalesce("_exact", "_second")).drop("_exact", "_second", "_bare")


def last_address(functions: DataFrame, order: str) -> DataFrame:
    """One row per normalised address; of duplicates the last by `order`."""
    rows = functions.withColumn("addr_key", address(F.col("addr")))
    return rows.groupBy("addr_key").agg(F.max_by("name", order).alias("name"))


def match_sources(sources: DataFrame, functions: DataFrame, order: str) -> DataFrame:
    """Patch sources with the function at their address, or an error."""
    known = last_address(functions, order)
    out = sources.withColumn("addr_key", address(F.col("addr"))).join(known, "addr_key", "left")
    message = F.concat(F.lit("Address "), F.col("addr"), F.lit(" not found in JSON mapping"))
    return out.withColumn("error", F.when(F.col("name").isNull(), message))


def recompile_inputs(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Candidates with their metadata by id as text ("007" is not "7"), last duplicate first; an error where there is none."""
    last = metadata.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by("func_def", "line_num").alias("func_def"))
    out = candidates.join(last, "id", "left")
    return out.withColumn("error", F.when(F.col("func_def").isNull(), F.lit("no metadata")))


def by_integer_id(objects: DataFrame, corpus: DataFrame) -> DataFrame:
    """Objects with corpus rows by id as a number ("007" is "7"), the last of each. If a corpus row lacks an id, the place of a row
    stands in from there on: all rows are known by their place, and those before it by their id too where that is no place."""
    lacking = corpus.where("id is null").agg(F.min("line_num").alias("n")).first()["n"]
    rest = [c for c in corpus.columns if c != "id"]
    early = corpus if lacking is None else corpus.where(F.col("line_num") < lacking)
    early = early.withColumn("_key", F.col("id").cast("long")).groupBy("_key").agg(F.max_by(F.struct(*rest), "line_num").alias("_r")).select("_key", "_r.*")
    if lacking is None:
        keyed = early
    else:
        placed = global_index(corpus, "line_num").withColumnRenamed("index", "_key").select("_key", *rest)
        keyed = placed.unionByName(early.join(placed.select("_key"), "_key", "left_anti"))
    out = objects.withColumn("_key", F.col("id").cast("long")).join(keyed.drop("line_num"), "_key", "left")
    return out.drop("_key")


def funnel(lines: DataFrame, levels: list[str] = OPT_LEVELS) -> DataFrame:
    """Corpus lines × levels with their outcome. lines: line_num, id, func_def, fault (why a line could not be read, or null). A
    line that can't be read, or lacks an id or a definition, is one row with no level and its message; other lines are a row for
    each level, not yet compiled."""
    line, own = F.col("line_num").cast("string"), F.col("id").cast("string")
    message = (
        F.when(F.col("fault").isNotNull(), F.format_string(UNREADABLE, line, "fault")).when(F.col("id").isNull(), F.format_string(NO_ID, line))
        .when(F.coalesce("func_def", F.lit("")) == "", F.format_string(NO_DEFINITION, line, own))
    )
    told = lines.withColumn("message", message)
    every = F.when(F.col("message").isNull(), F.array(*(F.lit(x) for x in levels))).otherwise(F.array(F.lit(None).cast("string")))
    return told.withColumn("opt", F.explode(every))


def level_counts(outcomes: DataFrame) -> DataFrame:
    """By opt, with "(all)" for all of them: attempted, compiled and errors. outcomes: opt, message (null if compiled). A line without a
    level counts as one error of all, and of no level."""
    rows = outcomes.withColumn("opt", F.explode(F.when(F.col("opt").isNull(), F.array(F.lit("(all)"))).otherwise(F.array("opt", F.lit("(all)")))))
    return rows.groupBy("opt").agg(F.count("*").alias("attempted"), F.count_if(F.col("message").isNull()).alias("compiled"), F.count("message").alias("errors"))


def expand(rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """A row per value: the cross product with a short list of constants."""
    return rows.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
