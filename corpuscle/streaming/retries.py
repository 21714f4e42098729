"""Retries that wait: states of request ranges by key, with timers.

Each outcome of a range (model, start, session, status, at) goes to the state of its range. A failed one has another try after
WAIT, three in all; a completed one is the end; the first outcome of a later session forgets the tries and what waits. A waiting
retry is due when the clock passes: at the next outcome of its range, or when the stream's watermark passes, whichever comes first,
so rows do not depend on how the stream is cut into batches. Outcomes of one key are taken in the order of their times.

Ranges are dealt into GROUPS groups by their key. What a group keeps is the small rows of its ranges, read and written once a batch, with
one timer for its earliest retry; a call for each range would cost some milliseconds, and there are millions. States and timers are the
state store's, so a lost executor costs a batch that runs again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuscle.operators.batch import RETRIES
from corpuscle.session import ship

WAIT = timedelta(seconds=60)
ACTIONS = "model string, start long, session long, action string, at timestamp, tries int"
#: Groups of ranges; a checkpoint holds states by them.
GROUPS = 1024
_STATE = "ranges array<struct<model: string, start: string, session: long, tries: int, done: boolean, due: long>>"
_TOLD = "model string, start string, session long, action string, at long, tries int"
#: The state store that keeps timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple[int, int, bool, int | None], session: int, status: str, at: int, wait: int) -> tuple[tuple[int, int, bool, int | None], list[tuple[int, str, int, int]]]:
    """The next state (session, tries, done, due) of a range after an outcome, and its actions (session, action, at, tries). Times in
    microseconds."""
    own, tries, done, due = state
    out = []
    if due is not None and due <= at:
        out.append((own, "retry", due, tries))
        due = None
    if done or session < own:
        return (own, tries, done, due), out
    if session > own:
        own, tries, due = session, 0, None
    if status == "completed":
        done, due = True, None
        out.append((own, "completed", at, tries))
    elif status == "failed" and tries < RETRIES:
        tries, due = tries + 1, None
        if tries < RETRIES:
            due = at + wait
        else:
            out.append((own, "failed", at, tries))
    return (own, tries, done, due), out


class Retry(StatefulProcessor):
    """Of a group of ranges (model, start as text); times in microseconds."""

    def __init__(self, wait: timedelta):
        self.wait = wait // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ranges", _STATE)

    def _ranges(self) -> dict[tuple, tuple[int, int, bool, int | None]]:
        return {(m, k): (own, tries, done, due) for m, k, own, tries, done, due in self.state.get()[0]} if self.state.exists() else {}

    def _passed(self, ranges: dict, clock: int) -> list[tuple]:
        """The retries that are due at the clock (milliseconds), which then wait no more."""
        out = []
        for key, (own, tries, done, due) in ranges.items():
            if due is not None and _ms(due) <= clock:
                out.append((*key, own, "retry", due, tries))
                ranges[key] = (own, tries, done, None)
        return out

    def _keep(self, ranges: dict) -> None:
        self.state.update(([(*key, *state) for key, state in ranges.items()],))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting = [due for *_, due in ranges.values() if due is not None]
        if waiting:
            self.handle.registerTimer(_ms(min(waiting)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        ranges, out = self._ranges(), []
        found = pd.concat(rows).sort_values("us", kind="stable")
        for model, start, session, status, at in zip(*(found[c].tolist() for c in ("model", "start", "session", "status", "us")), strict=True):
            ranges[model, start], more = step(ranges.get((model, start), (0, 0, False, None)), int(session), status, at, self.wait)
            out += ((model, start, *row) for row in more)
        out += self._passed(ranges, timerValues.getCurrentWatermarkInMs())
        self._keep(ranges)
        yield _rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        ranges = self._ranges()
        out = self._passed(ranges, timerValues.getCurrentWatermarkInMs())
        self._keep(ranges)
        yield _rows(out)

    def close(self) -> None:
        pass


def _ms(due: int) -> int:
    """Timers and watermarks count milliseconds."""
    return -(-due // 1000)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["model", "start", "session", "action", "at", "tries"])


def retries(outcomes: DataFrame, wait: timedelta = WAIT) -> DataFrame:
    """The actions of a stream of outcomes (model, start, session, status, at): retry (when it is due), completed, failed (after the last
    try). `at` needs a watermark, and the session the state store STORE."""
    ship(outcomes.sparkSession)
    group = F.pmod(F.xxhash64("model", "start"), F.lit(GROUPS)).alias("group")
    rows = outcomes.select(group, "model", F.col("start").cast("string").alias("start"), "session", "status", "at", F.unix_micros("at").alias("us"))
    told = rows.groupBy("group").transformWithStateInPandas(Retry(wait), outputStructType=_TOLD, outputMode="Append", timeMode="EventTime")
    return told.select("model", F.col("start").cast("long").alias("start"), "session", "action", F.timestamp_micros("at").alias("at"), "tries")


def timer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state where timers are; the given one is left as it is."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return own
