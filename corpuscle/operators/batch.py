"""Batches of model requests: ranges, their states, results of two providers in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 100
RETRIES = 3


def batch_status(provider: Column, status: Column) -> Column:
    """One vocabulary for two providers; expired is completed for the first and failed for the second."""
    first = (
        F.when(status.isin("validating", "in_progress", "finalizing"), "in_progress").when(status.isin("completed", "expired"), "completed")
        .when(status == "failed", "failed").when(status.isin("cancelling", "cancelled"), "cancelled").otherwise("unknown")
    )
    second = (
        F.when(status == "in_progress", "in_progress").when(status == "ended", "completed").when(status.isin("failed", "expired"), "failed")
        .when(status == "canceled", "cancelled").otherwise("unknown")
    )
    return F.when(provider == "openai", first).otherwise(second)


def progress(provider: Column, counts: Column) -> Column:
    """total, completed, failed and processing from a provider's own counts (a map of names to numbers, null counts as empty). The
    first gives a total and leaves the open ones to be found; of the second the total is the sum of all its counts."""
    own = F.coalesce(counts, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    n = lambda key: F.coalesce(F.try_element_at(own, F.lit(key)), F.lit(0))
    every = F.aggregate(F.map_values(own), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    parts = {
        "total": (n("total"), every), "completed": (n("completed"), n("succeeded")), "failed": (n("failed"), n("errored")),
        "processing": (n("total") - n("completed") - n("failed"), n("processing")),
    }
    return F.struct(*(F.when(provider == "openai", a).otherwise(b).cast("long").alias(name) for name, (a, b) in parts.items()))


def standard_results(lines: DataFrame) -> DataFrame:
    """custom_id, response, error and tokens from raw lines (provider, raw)."""
    j = lambda path: F.get_json_object("raw", path)
    first = F.col("provider") == "openai"
    kind = j("$.result.type")
    response = F.when(first, j("$.response.body.choices[0].message.content")).otherwise(F.when(kind == "succeeded", j("$.result.message.content[0].text")))
    error = F.when(first, j("$.error")).otherwise(F.when(kind.isin("failed", "error"), F.coalesce(j("$.result.error"), F.lit("Unknown error"))))
    number = lambda a, b: F.coalesce(F.when(first, j(a)).otherwise(j(b)).cast("long"), F.lit(0))
    out = lines.select(
        "provider", j("$.custom_id").alias("custom_id"), response.alias("response"), error.alias("error"),
        number("$.response.body.usage.prompt_tokens", "$.result.message.usage.input_tokens").alias("input_tokens"),
        number("$.response.body.usage.completion_tokens", "$.result.message.usage.output_tokens").alias("output_tokens"),
        F.coalesce(j("$.response.body.usage.total_tokens").cast("long"), F.lit(0)).alias("_total"),
    )
    total = F.when(F.col("provider") == "openai", F.col("_total")).otherwise(F.col("input_tokens") + F.col("output_tokens"))
    return out.withColumn("total_tokens", total).drop("_total")


def is_error(known: Column) -> Column:
    """A result without a usable answer, or with one that nobody asked for."""
    bad = F.coalesce(F.col("error"), F.lit("")) != ""
    return bad | (F.coalesce(F.col("response"), F.lit("")) == "") | ~known


def join_requests(results: DataFrame, requests: DataFrame) -> DataFrame:
    known = requests.select("custom_id").distinct().withColumn("_known", F.lit(True))
    out = results.join(known, "custom_id", "left")
    return out.withColumn("failed", is_error(F.coalesce("_known", F.lit(False)))).drop("_known")


def batch_counts(results: DataFrame) -> DataFrame:
    """By provider: n_results, n_failed and sums of tokens."""
    return results.groupBy("provider").agg(
        F.count("*").alias("n_results"), F.count_if("failed").alias("n_failed"),
        *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")),
    )


def ranges(total: int, size: int = BATCH) -> list[tuple[int, int]]:
    return [(i, min(i + size, total)) for i in range(0, total, size)]


def with_range(rows: DataFrame, index: str, size: int = BATCH) -> DataFrame:
    return rows.withColumn("range_start", F.floor(F.col(index) / size) * size)


def range_table(rows: DataFrame, index: str, size: int = BATCH) -> DataFrame:
    """range_start, range_end, n of the ranges that hold rows."""
    out = with_range(rows, index, size).groupBy("range_start").agg((F.max(index) + 1).alias("range_end"), F.count("*").alias("n"))
    return out.withColumn("range_start", F.col("range_start").cast("long"))


def advance(state: DataFrame, outcomes: DataFrame, session: str) -> DataFrame:
    """The next state table (model, session_id, start, end, status, batch_id, retries) after outcomes (model, start, status,
    batch_id). Ranges of another session that are not completed start again; a failed range is pending until its retries end."""
    fresh = F.coalesce(F.col("session_id") != session, F.lit(True)) & (F.col("status") != "completed")
    now = (
        state.withColumn("_fresh", fresh).withColumn("status", F.when(F.col("_fresh"), "pending").otherwise(F.col("status")))
        .withColumn("retries", F.when(F.col("_fresh"), 0).otherwise(F.col("retries"))).withColumn("session_id", F.lit(session)).drop("_fresh")
    )
    told = outcomes.select("model", "start", F.col("status").alias("_status"), F.col("batch_id").alias("_batch"))
    out = now.join(told, ["model", "start"], "left")
    bad = F.coalesce(F.col("_status") == "failed", F.lit(False)) & (F.col("status") != "completed")
    tries = F.when(bad, F.col("retries") + 1).otherwise(F.col("retries"))
    status = F.when(F.col("status") == "completed", F.col("status")).when(bad, F.when(tries >= RETRIES, "failed").otherwise("pending")).otherwise(F.coalesce("_status", "status"))
    return out.select("model", "session_id", "start", "end", status.alias("status"), F.coalesce("_batch", "batch_id").alias("batch_id"), tries.alias("retries"))


def range_progress(state: DataFrame) -> DataFrame:
    """By model: completed, failed, total, and whether all is done."""
    out = state.groupBy("model").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
    return out.withColumn("ok", F.col("completed") == F.col("total"))
