"""Registered queries over states that are kept: range tables, retries that wait, rollups of streams."""

from __future__ import annotations

from datetime import timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import taxonomy
from corpuscle.operators import range_state, rollup
from corpuscle.plans import views as v
from corpuscle.plans.files import written_files
from corpuscle.plans.labels import CONFIG_STATS, sql_compile
from corpuscle.plans.registry import query
from corpuscle.sources.shared import exists, scratch
from corpuscle.streaming import ingest, retries

#: Events of a batch of outcomes, and of a range of requests.
_BATCH, _RANGE = 4000, 100
#: Sessions that the batches after the second one are spread over.
_SESSIONS = 4
_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' END"


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of ranges of five models: one for each event that failed or completed, of the range of the request after it."""
    e = v.read(spark, sf, "events").select(
        F.concat(F.lit("m"), F.expr("user_id % 5")).alias("model"), F.expr(f"event_id % {_BATCH} div 4 * 4 div {_RANGE} * {_RANGE}").alias("start"),
        F.expr(_STATUS).alias("status"), F.concat(F.lit("b"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("batch_id"), F.expr(f"event_id div {_BATCH}").alias("part"),
    )
    return e.where("status is not null")


# Batches one after the other: per range the failed ones of each, at most three in all, and a completed one that comes before the third.
_STATE_SQL = f"""WITH RECURSIVE o AS (SELECT 'm' || user_id % 5 AS model, event_id % {_BATCH} // 4 * 4 // {_RANGE} * {_RANGE} AS start, {_STATUS} AS status, 'b' || lpad(event_id::VARCHAR, 12, '0') AS batch_id, event_id // {_BATCH} AS part FROM events),
t AS (SELECT part, model, start, count(*) FILTER (status = 'completed') AS good, count(*) FILTER (status = 'failed') AS bad, coalesce(max(batch_id) FILTER (status = 'completed'), max(batch_id) FILTER (status = 'failed')) AS batch FROM o WHERE status IS NOT NULL GROUP BY ALL),
n AS (SELECT 'm' || m AS model, s AS start FROM (SELECT unnest(range(5)) AS m), (SELECT unnest(range(0, {_BATCH}, {_RANGE})) AS s)),
s(part, model, start, status, batch_id, retries) AS (SELECT -1::BIGINT, model, start, 'pending', NULL::VARCHAR, 0::BIGINT FROM n UNION ALL
  SELECT s.part + 1, s.model, s.start,
    CASE WHEN s.status = 'completed' OR (coalesce(good, 0) > 0 AND least(r.tries + coalesce(bad, 0), 3) < 3) THEN 'completed' WHEN coalesce(bad, 0) > 0 THEN CASE WHEN r.tries + bad >= 3 THEN 'failed' ELSE 'pending' END ELSE r.status END,
    CASE WHEN s.status = 'completed' THEN s.batch_id ELSE coalesce(batch, r.batch_id) END, CASE WHEN s.status = 'completed' THEN s.retries ELSE least(r.tries + coalesce(bad, 0), 3) END
  FROM s, LATERAL (SELECT CASE WHEN s.part = 0 AND s.status <> 'completed' THEN 0 ELSE s.retries END AS tries, CASE WHEN s.part = 0 AND s.status <> 'completed' THEN 'pending' ELSE s.status END AS status, CASE WHEN s.part = 0 AND s.status <> 'completed' THEN NULL ELSE s.batch_id END AS batch_id) r
  LEFT JOIN t ON t.part = s.part + 1 AND t.model = s.model AND t.start = s.start WHERE s.part < (SELECT max(event_id // {_BATCH}) FROM events))
SELECT model, start, start + {_RANGE} AS end, status, batch_id, retries FROM s WHERE part = (SELECT max(event_id // {_BATCH}) FROM events)"""


@query(_STATE_SQL)
def durable_range_state(spark: SparkSession, sf: str) -> DataFrame:
    """The states after all batches of outcomes, merged from streams. The first batch belongs to one session; a second one starts after
    it; the others come in sessions that resume it, a fixed number of them, each of which merges its batches in their order and in one
    step. Each batch is offered twice."""
    root = scratch(spark)
    last = v.read(spark, sf, "events").agg(F.max(F.expr(f"event_id div {_BATCH}"))).first()[0]
    count = 0 if last is None else last + 1
    session = F.when(F.col("part") < 2, F.col("part")).otherwise(F.expr(f"2 + (part - 2) * {_SESSIONS} div {max(count - 2, 1)}"))
    _outcomes(spark, sf).withColumn("session", session).write.partitionBy("session").parquet(f"{root}/in")
    n = F.explode(F.array(*(F.lit(f"m{i}") for i in range(5))))
    requests = v.read(spark, sf, "events").where(f"event_id < {_BATCH}").select(n.alias("model"), F.col("event_id").alias("index")).unionByName(spark.range(1).select(n.alias("model"), F.lit(_BATCH - 1).cast("long").alias("index")))
    for own in range(min(count, 2 + _SESSIONS)):
        table = range_state.RangeTable(spark, f"{root}/state")
        table.begin(requests, resume=own > 1, size=_RANGE)
        if not exists(spark, f"{root}/in/session={own}"):
            continue
        stream = spark.readStream.schema(f"{range_state.OUTCOMES}, part long").parquet(f"{root}/in/session={own}")
        for k in range(2):  # the second one has a checkpoint of its own, so it offers batch 0 again
            table.follow(stream, f"session{own}", f"{root}/at{own}-{k}", merge=partial(table.merge, order="part")).awaitTermination()
    return range_state.RangeTable(spark, f"{root}/state").read().withColumn("retries", F.col("retries").cast("long"))


_WAIT = timedelta(hours=6)
_ROWS = f"(SELECT 'm' || user_id AS model, event_id // 1000 % 10 AS start, event_id // 4000 + 1 AS session, {_STATUS} AS status, ts FROM events)"


@query(f"""WITH a AS (SELECT *, min(CASE WHEN status = 'completed' THEN ts END) OVER (PARTITION BY model, start) AS done, row_number() OVER (PARTITION BY model, start, session ORDER BY ts) AS place FROM {_ROWS}),
i AS (SELECT *, lead(ts) OVER (PARTITION BY model, start ORDER BY ts) AS next, count(CASE WHEN status = 'failed' THEN 1 END) OVER (PARTITION BY model, start, session ORDER BY ts) AS n
  FROM a WHERE (done IS NULL OR ts <= done) AND (status IS NOT NULL OR place = 1)),
e AS (SELECT max(ts) AS last FROM a),
r AS (SELECT model, start, session, 'retry' AS action, ts + INTERVAL 6 HOUR AS ts, n AS tries FROM i, e WHERE status = 'failed' AND n < 3 AND ts + INTERVAL 6 HOUR <= coalesce(next, last)
  UNION ALL SELECT model, start, session, status, ts, least(n, 3) FROM i WHERE status = 'completed' OR (status = 'failed' AND n = 3))
SELECT model, start, session, action, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "at", tries FROM r""")
def waiting_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Retries when they are due, and the ends of ranges, from a stream of outcomes."""
    root, own = scratch(spark), retries.timer_session(spark)
    e = v.read(spark, sf, "events").select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"), F.expr("event_id div 1000 % 10").alias("start"), F.expr("event_id div 4000 + 1").alias("session"),
        F.coalesce(F.expr(_STATUS), F.lit("running")).alias("status"), F.col("ts").cast("timestamp").alias("at"),
    )
    e.write.parquet(f"{root}/in")
    outcomes = own.readStream.schema(e.schema).parquet(f"{root}/in").withWatermark("at", "0 seconds")
    told = retries.retries(outcomes, _WAIT).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/at")
    told.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(retries.ACTIONS).parquet(f"{root}/out")
    return out.select("model", "start", "session", "action", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("tries").cast("long").alias("tries"))


@query(CONFIG_STATS.format(keys="iteration, model, ir, opt", rows=sql_compile()))
def streamed_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of compile_taxonomy_by_config from counts that a stream of files keeps, over three runs."""
    root, keys = scratch(spark), ["iteration", *rollup.CONFIG]
    files = v.compile_errors(spark, sf)
    for run in range(3):
        files.where(F.pmod(F.xxhash64("file"), F.lit(3)) == run).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(files.schema).parquet(f"{root}/in")
        labels = rollup.explode_labels(taxonomy.with_labels(stream, "content", taxonomy.COMPILE["detailed"]).drop("content"), F.col("found"))
        ingest.keep_label_counts(labels, [*keys, *rollup.LABEL], f"{root}/counts", f"{root}/at").awaitTermination()
    return rollup.config_stats(ingest.label_totals(spark, f"{root}/counts", [*keys, *rollup.LABEL]), keys)


@query(f"SELECT doc_id || '.error' AS file, l.category AS category, l.subcategory AS subcategory FROM (SELECT doc_id, unnest({taxonomy.sql_labels('content', taxonomy.COMPILE['detailed'])}) AS l FROM (SELECT doc_id, {v._list(v.ERRORS)}[doc_id % {len(v.ERRORS)} + 1] AS content FROM documents))")
def streamed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of compile error files as they arrive."""
    root = written_files(spark, sf, "errors", v._pick(v.ERRORS, f"doc_id % {len(v.ERRORS)}"))
    labels = ingest.label_stream(spark, root)
    ingest.run_available(labels, f"{root}-out", f"{root}-at").awaitTermination()
    return spark.read.schema(labels.schema).parquet(f"{root}-out").select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "category", "subcategory")
