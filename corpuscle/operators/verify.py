"""Comparison of observed with expected outputs, pass rates and test reports."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import ship


def same_value(observed: object, expected: object) -> bool:
    """Deep comparison: types must be the same, floats may differ by 1e-9 of their size, and only the observed keys of an object
    are looked at (so an empty one equals any)."""
    if type(observed) is not type(expected):
        return False
    if isinstance(observed, list):
        return len(observed) == len(expected) and all(map(same_value, observed, expected))
    if isinstance(observed, dict):
        return all(k in expected and same_value(v, expected[k]) for k, v in observed.items())
    if isinstance(observed, float):
        return math.isclose(observed, expected, rel_tol=1e-9, abs_tol=0.0)
    return observed == expected


def _parsed(text: str | None) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def same_series(observed: pd.Series, expected: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(observed, expected, strict=True):
        (ok, x), (also, y) = _parsed(a), _parsed(b)
        out.append(same_value(x, y) if ok and also else None)
    return pd.Series(out, dtype="object")


def same_json(observed: Column | str, expected: Column | str) -> Column:
    """Whether two JSON texts hold the same value; null if either is none. Arrow batches, as the recursion over values of any
    shape is no column expression."""
    if SparkSession.getActiveSession():
        ship(SparkSession.getActiveSession())
    return F.pandas_udf(same_series, T.BooleanType())(observed, expected)


def same_flat(observed: Column, expected: Column) -> Column:
    """same_value() for maps of doubles, without Python."""
    close = lambda a, b: (a == b) | (F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b)))
    return F.forall(F.map_entries(observed), lambda e: F.coalesce(close(e["value"], F.try_element_at(expected, e["key"])), F.lit(False)))


def pass_rates(tests: DataFrame, keys: list[str], passed: str = "passed") -> DataFrame:
    """successes, total, pct (0 without tests) and all_passed by the keys."""
    out = tests.groupBy(*keys).agg(F.count_if(passed).alias("successes"), F.count("*").alias("total"))
    pct = F.when(F.col("total") > 0, F.col("successes") / F.col("total") * 100).otherwise(0.0)
    return out.withColumn("pct", pct).withColumn("all_passed", F.col("successes") == F.col("total"))


def overall_rate(rates: DataFrame) -> DataFrame:
    """Functions with all tests passed, of all."""
    out = rates.agg(F.count_if("all_passed").alias("fully_passed"), F.count("*").alias("n_functions"))
    return out.withColumn("success_rate", F.when(F.col("n_functions") > 0, F.col("fully_passed") / F.col("n_functions") * 100).otherwise(0.0))


def report_text(fname: Column, binary: Column, successes: Column, total: Column, failures: Column) -> Column:
    """A test report; `failures` are the lines of failed tests."""
    pct = F.when(total > 0, successes / total * 100).otherwise(F.lit(0.0))
    head = F.format_string("Function: %s\nBinary: %s\nTests: %d/%d passed (%.1f%%)\n", fname, binary, successes, total, pct)
    good = F.lit("Status: ALL TESTS PASSED ✓\n")
    bad = F.concat(F.lit("Status: SOME TESTS FAILED ✗\n\nFailed tests:\n"), F.array_join(F.transform(failures, lambda x: F.concat(F.lit("  - "), x)), "\n"), F.lit("\n"))
    return F.concat(head, F.when(successes == total, good).otherwise(bad))


def error_report_text(fname: Column, binary: Column, error: Column) -> Column:
    """The report of a function whose tests could not run."""
    return F.format_string("Function: %s\nBinary: %s\nStatus: COMPILATION/EXECUTION ERROR ✗\nError: %s\n", fname, binary, error)


def parse_report(reports: DataFrame, content: str = "content") -> DataFrame:
    """Adds fname, successes, total, status and n_failed_lines of report texts."""
    c = F.col(content)
    number = lambda i: F.nullif(F.regexp_extract(c, "(?m)^Tests: ([0-9]+)/([0-9]+) passed", i), F.lit("")).cast("int")
    return (
        reports.withColumn("fname", F.regexp_extract(c, "(?m)^Function: (.*)$", 1)).withColumn("successes", number(1)).withColumn("total", number(2))
        .withColumn("status", F.regexp_extract(c, "(?m)^Status: ([A-Z/ ]*[A-Z])", 1))
        .withColumn("n_failed_lines", F.regexp_count(c, F.lit("(?m)^  - Test [0-9]+: ")))
    )
