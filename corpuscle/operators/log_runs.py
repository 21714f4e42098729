"""Runs within event logs: a header, events, and a trailer that tells counts; several runs may follow one another in a file.

A line belongs to the run whose header is the last one at or before it, so a run's number is a running count of headers in line
order. The count is taken within ranges of RANGE lines, and sums over the ranges before are added: no window sees a whole file.

The trailers of the scripts are printed from counters that a pipeline keeps in a process of its own, so they may tell zeros;
`run_summaries` counts the events again and says where the two differ. Stamps of headers and trailers are UTC; those of the types in
LOCAL are local times of the machine that wrote them, whose distance from UTC is told in steps of a quarter of an hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.sources.readers import LOG_FIELDS

#: Lines of a range.
RANGE = 1 << 16
#: Marks of a log.
STARTED, FINISHED, SUMMARY, END = "# Generated: ", "# Processing finished: ", "[SUMMARY]", "[END]"
#: What the lines of a trailer begin with, for either suite.
TRAILER = {"told_processed": ["Files processed: "], "told_ok": ["Files patched successfully: ", "Files tested successfully: "], "told_errors": ["Patching errors: ", "Testing errors: "]}
#: Types whose events have local stamps.
LOCAL = ["PATCH", "JSON_LOAD"]


def running_count(rows: DataFrame, keys: list[str], order: str, mark: Column, name: str, size: int = RANGE) -> DataFrame:
    """Adds `name`: how many rows at or before this one, by `order` (whole numbers from 0), have the mark, within the keys."""
    marked = rows.withColumn("_range", F.floor(F.col(order) / size)).withColumn("_mark", mark.cast("long"))
    sums = marked.groupBy(*keys, "_range").agg(F.sum("_mark").alias("_sum"))  # one row a range
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_mark").over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).join(before, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_mark", "_own", "_before")


def with_runs(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """Adds run (from 1; 0 before the first header) to numbered lines (file, line_num, value)."""
    return running_count(lines, ["file"], "line_num", F.startswith("value", F.lit(STARTED)), "run", size)


def _after(value: Column, *starts: str) -> Column:
    """What follows one of the starts of a line; null of other lines."""
    return F.coalesce(*(F.when(F.startswith(value, F.lit(s)), F.substring(value, F.lit(len(s) + 1), F.length(value))) for s in starts))


def run_summaries(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """By file and run: started and finished (UTC), complete (it has an end), events and errors counted again, what the trailer tells,
    as_told (null without a trailer), and by how many minutes local stamps differ from UTC. `lines`: file, line_num, value."""
    v = F.col("value")
    parts = F.split(v, r"\|", len(LOG_FIELDS))
    event = (F.size(parts) == len(LOG_FIELDS)) & ~F.startswith(v, F.lit("#"))
    slim = with_runs(lines, size).select(
        "file", "run", _after(v, STARTED).alias("started"), _after(v, FINISHED).alias("finished"), (v == END).alias("ends"),
        *(F.try_to_number(_after(v, *starts), F.lit("999999999999999999")).cast("long").alias(n) for n, starts in TRAILER.items()),
        F.when(event, F.get(parts, 0)).alias("status"), F.when(event, F.get(parts, 1)).alias("type"), F.when(event, F.get(parts, 4)).alias("stamp"),
    )
    local = F.col("type").isin(LOCAL)
    time = F.try_to_timestamp("stamp")
    found = slim.groupBy("file", "run").agg(
        F.min(F.try_to_timestamp("started")).alias("started"), F.max(F.try_to_timestamp("finished")).alias("finished"), F.max("ends").alias("complete"),
        F.count("status").alias("n_events"), F.count_if(F.col("status") == "SUCCESS").alias("n_ok"), F.count_if(F.col("status") == "ERROR").alias("n_errors"),
        *(F.max(n).alias(n) for n in TRAILER), F.min(F.when(local, time)).alias("_local"),
    )
    same = (F.col("told_processed") == F.col("n_events")) & (F.col("told_ok") == F.col("n_ok")) & (F.col("told_errors") == F.col("n_errors"))
    quarter = F.floor((F.unix_timestamp("_local") - F.unix_timestamp("started")) / 900) * 15
    return found.where("run > 0").withColumn("as_told", same).withColumn("local_minutes", quarter).drop("_local")
