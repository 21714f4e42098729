"""Durable states of request ranges: a versioned table whose pointer changes in one step.

Each change writes a whole new version (one row a range) and then replaces the pointer, a small file that names the version, the
session, and the last batch of each stream that was merged. A crash between the two leaves the pointer at the old version, and the
next change writes its version anew. A batch that comes twice changes nothing, as the pointer tells that it is merged.

Ranges start pending; a completed one stays; a failed one has another try, three in all; a resumed session keeps what is there, and
a new one sets every range that is not completed to pending, without a batch and tries.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import suppress
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.operators import batch
from corpuscle.sources.shared import read_small, remove, replace_small

STATE = "model string, start long, end long, status string, batch_id string, retries int"
OUTCOMES = "model string, start long, status string, batch_id string"


@dataclass
class Pointer:
    version: int = 0
    session: int = 0
    merged: dict[str, int] = field(default_factory=dict)


class RangeTable:
    """The states below a folder that all sessions share. One session writes at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # versions

    def pointer(self) -> Pointer:
        text = read_small(self.spark, f"{self.root}/CURRENT")
        return Pointer(**json.loads(text)) if text else Pointer()

    def _folder(self, version: int) -> str:
        return f"{self.root}/v{version:09d}"

    def read(self) -> DataFrame:
        at = self.pointer()
        if not at.version:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self._folder(at.version))

    def _commit(self, state: DataFrame, at: Pointer, session: int, merged: dict[str, int]) -> None:
        """The next version; the one before stays for readers that have opened it, older ones go."""
        rows = state.select(*(F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in STATE.split(", ")))
        rows.write.mode("overwrite").parquet(self._folder(at.version + 1))
        replace_small(self.spark, f"{self.root}/CURRENT", json.dumps(asdict(Pointer(at.version + 1, session, merged))))
        if at.version > 1:
            with suppress(Exception):  # the next change tries again
                remove(self.spark, self._folder(at.version - 1))

    # changes

    def begin(self, requests: DataFrame, *, resume: bool = False, size: int = batch.BATCH) -> int:
        """Starts a session, or resumes the last one, over requests (model, index): models that are not known get their ranges, which
        are made of the largest index. Returns the session's number."""
        at, now = self.pointer(), self.read()
        session = max(at.session, 1) if resume else at.session + 1
        if not resume:
            open_ = F.col("status") != "completed"
            now = now.select("model", "start", "end", F.when(open_, "pending").otherwise(F.col("status")).alias("status"), F.when(~open_, F.col("batch_id")).alias("batch_id"), F.when(open_, 0).otherwise(F.col("retries")).alias("retries"))
        totals = requests.groupBy("model").agg((F.max("index") + 1).alias("n")).join(now.select("model").distinct(), "model", "left_anti")
        starts = totals.select("model", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("start"))
        fresh = starts.select("model", "start", F.least(F.col("start") + size, "n").alias("end"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("batch_id"), F.lit(0).alias("retries"))
        self._commit(now.unionByName(fresh), at, session, {} if not resume else at.merged)
        return session

    def due(self) -> DataFrame:
        """The ranges that are to be sent: neither completed nor out of tries."""
        return self.read().where((F.col("status") != "completed") & (F.col("retries") < batch.RETRIES))

    def merge(self, outcomes: DataFrame, stream: str, number: int, order: str | None = None) -> bool:
        """Outcomes (model, start, status, batch_id) of one batch of a stream; False if it is merged already. Several outcomes of a
        range are tries one after the other, of which a completed one is the last. `order` names a column that cuts the outcomes into
        parts: they are merged as if one came after the other, in one version however many there are. A range has a row for each part."""
        at = self.pointer()
        if number <= at.merged.get(stream, -1):
            return False
        part = F.lit(0) if order is None else F.col(order)
        told = outcomes.select("*", part.alias("_part")).groupBy("model", "start", "_part").agg(
            F.count_if(F.col("status") == "completed").alias("_good"), F.count_if(F.col("status") == "failed").alias("_bad"),
            F.max_by("batch_id", F.struct(F.col("status") == "completed", "batch_id")).alias("_batch"),
        )
        now = self.read()
        so_far = F.sum("_bad").over(Window.partitionBy("model", "start").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        tried = told.join(now.select("model", "start", "retries"), ["model", "start"]).withColumn("_tries", F.least(F.col("retries") + so_far, F.lit(batch.RETRIES)))
        ends = (F.col("_good") > 0) & (F.col("_tries") < batch.RETRIES)
        folded = tried.groupBy("model", "start").agg(
            F.min_by(F.when(ends, F.struct("_batch", "_tries")), F.when(ends, F.col("_part"))).alias("_end"),
            F.max_by("_batch", F.when(F.col("_batch").isNotNull(), F.col("_part"))).alias("_last"), F.max("_tries").alias("_tries"), (F.max("_bad") > 0).alias("_failed"),
        )
        rows = now.join(folded, ["model", "start"], "left")
        done, good = F.col("status") == "completed", F.col("_end").isNotNull()
        tries = F.coalesce("_end._tries", "_tries", "retries")
        status = F.when(done | good, "completed").when(F.col("_failed"), F.when(tries >= batch.RETRIES, "failed").otherwise("pending")).otherwise(F.col("status"))
        told_last = F.coalesce(F.when(good, F.col("_end._batch")).otherwise(F.col("_last")), "batch_id")
        state = rows.select("model", "start", "end", status.alias("status"), F.when(done, F.col("batch_id")).otherwise(told_last).alias("batch_id"), F.when(done, F.col("retries")).otherwise(tries).alias("retries"))
        self._commit(state, at, at.session, {**at.merged, stream: number})
        return True

    def follow(self, outcomes: DataFrame, stream: str, checkpoint: str, *, merge: Callable[[DataFrame, str, int], object] | None = None) -> StreamingQuery:
        """Merges a stream of outcomes, as far as it is there; a later call goes on from the checkpoint."""
        own = merge or self.merge
        return outcomes.writeStream.foreachBatch(lambda rows, number: own(rows, stream, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
