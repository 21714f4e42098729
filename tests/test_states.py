"""Durable states, retries by a fixed clock, and counts of streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import range_state
from corpuscle.sources import shared
from corpuscle.streaming import ingest, retries

T0 = datetime(2024, 1, 1)
SECOND = timedelta(seconds=1)


def states(table):
    return {(r["model"], r["start"]): (r["end"], r["status"], r["batch_id"], r["retries"]) for r in table.read().collect()}


def outcomes(spark, *rows):
    return spark.createDataFrame(rows, range_state.OUTCOMES)


def test_ranges_live_over_sessions(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    table = range_state.RangeTable(spark, root)
    assert table.read().count() == 0
    requests = spark.range(250).select(F.lit("m").alias("model"), F.col("id").alias("index"))
    assert table.begin(requests) == 1
    assert states(table) == {("m", 0): (100, "pending", None, 0), ("m", 100): (200, "pending", None, 0), ("m", 200): (250, "pending", None, 0)}
    assert table.merge(outcomes(spark, ("m", 0, "completed", "b1"), ("m", 100, "failed", "b2"), ("x", 0, "failed", "no range")), "s", 0)
    again = range_state.RangeTable(spark, root)  # another session reads the same
    assert not again.merge(outcomes(spark, ("m", 100, "failed", "b2")), "s", 0)
    assert again.begin(requests, resume=True) == 1
    assert not again.merge(outcomes(spark, ("m", 100, "failed", "b2")), "s", 0)
    assert states(again) == {("m", 0): (100, "completed", "b1", 0), ("m", 100): (200, "pending", "b2", 1), ("m", 200): (250, "pending", None, 0)}
    again.merge(outcomes(spark, ("m", 100, "failed", "b3"), ("m", 100, "completed", "b4"), ("m", 200, "failed", "c1"), ("m", 200, "failed", "c2"), ("m", 200, "failed", "c3")), "s", 1)
    assert states(again) == {("m", 0): (100, "completed", "b1", 0), ("m", 100): (200, "completed", "b4", 2), ("m", 200): (250, "failed", "c3", 3)}
    assert again.due().count() == 0
    more = requests.unionByName(spark.range(1).select(F.lit("n").alias("model"), F.col("id").alias("index")))
    assert range_state.RangeTable(spark, root).begin(more) == 2
    assert states(table) == {("m", 0): (100, "completed", "b1", 0), ("m", 100): (200, "completed", "b4", 2), ("m", 200): (250, "pending", None, 0), ("n", 0): (1, "pending", None, 0)}
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("v")]) == 2  # old versions go


def test_many_batches_in_one_step(spark, tmp_path):
    dice = random.Random(11)
    requests = spark.range(1000).select(F.lit("m").alias("model"), F.col("id").alias("index"))
    rows = [("m", dice.randrange(10) * 100, dice.choice(["failed", "failed", "completed", "running"]), f"b{i:03d}", i // 9) for i in range(90)]
    one, all_ = (range_state.RangeTable(spark, f"file://{tmp_path}/{n}") for n in ("one", "all"))
    for table in (one, all_):
        table.begin(requests)
    for part in range(10):
        assert one.merge(outcomes(spark, *(r[:4] for r in rows if r[4] == part)), "s", part)
    dealt = spark.createDataFrame(dice.sample(rows, len(rows)), f"{range_state.OUTCOMES}, part long")
    assert all_.merge(dealt, "s", 0, "part") and not all_.merge(dealt, "s", 0, "part")
    assert states(all_) == states(one) and {s[1] for s in states(one).values()} >= {"completed", "failed"}
    assert all_.pointer().version == 2  # one version, however many batches


def test_versions_do_not_grow_with_batches(spark, tmp_path, monkeypatch):
    from corpuscle.plans import states as plans

    spark.range(60000).selectExpr("id AS event_id", "id % 7 AS user_id", "CASE WHEN id % 5 = 0 THEN 'error' WHEN id % 31 = 0 THEN 'purchase' ELSE 'view' END AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    versions, commit = [], range_state.RangeTable._commit
    monkeypatch.setattr(range_state.RangeTable, "_commit", lambda self, *a: (versions.append(1), commit(self, *a))[1])
    assert plans.durable_range_state(spark, str(tmp_path)).count() == 200
    assert len(versions) <= 2 * (2 + plans._SESSIONS)


def test_a_crash_between_version_and_pointer(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    table = range_state.RangeTable(spark, root)
    table.begin(spark.range(150).select(F.lit("m").alias("model"), F.col("id").alias("index")))
    spark.createDataFrame([("m", 0, "failed", "b1"), ("m", 100, "completed", "b2")], range_state.OUTCOMES).write.parquet(f"{root}-in")
    stream = lambda: spark.readStream.schema(range_state.OUTCOMES).parquet(f"{root}-in")
    before = states(table)

    def lost(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(range_state, "replace_small", lost)
    with pytest.raises(Exception, match="the driver is gone"):
        table.follow(stream(), "s", f"{root}-at").awaitTermination()
    assert states(range_state.RangeTable(spark, root)) == before  # the version is written, the pointer is not
    monkeypatch.undo()
    after = range_state.RangeTable(spark, root)
    after.begin(spark.range(150).select(F.lit("m").alias("model"), F.col("id").alias("index")), resume=True)
    after.follow(stream(), "s", f"{root}-at").awaitTermination()
    assert states(after) == {("m", 0): (100, "pending", "b1", 1), ("m", 100): (150, "completed", "b2", 0)}
    after.follow(stream(), "s", f"{root}-other").awaitTermination()  # the same batch by a stream that forgot it
    assert states(after) == {("m", 0): (100, "pending", "b1", 1), ("m", 100): (150, "completed", "b2", 0)}


def test_a_pointer_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/CURRENT"
    assert shared.read_small(spark, path) is None
    for text in ("one", "two é"):
        shared.replace_small(spark, path, text)
        assert shared.read_small(spark, path) == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["CURRENT"]


def test_steps_of_a_range():
    dice = random.Random(8)
    for _ in range(300):
        at, session, state, done, fails, waits, told, want = 0, 1, (0, 0, False, None), False, 0, None, [], []
        for _ in range(dice.randrange(1, 15)):
            at += dice.randrange(1, 40)
            fresh = dice.random() < 0.1
            status = dice.choice(["failed", "failed", "failed", "running", "completed"])
            session += fresh
            state, out = retries.step(state, session, status, at, 60)
            told += [(a, t, n) for _, a, t, n in out]
            if waits is not None and waits <= at:
                want.append(("retry", waits, fails))
                waits = None
            if done:
                continue
            if fresh:
                fails, waits = 0, None
            if status == "completed":
                done, waits = True, None
                want.append(("completed", at, fails))
            elif status == "failed" and fails < 3:
                fails += 1
                waits = at + 60 if fails < 3 else None
                if fails == 3:
                    want.append(("failed", at, 3))
        assert told == want


def test_retries_wait_for_the_clock(spark, tmp_path):
    own, kind = retries.timer_session(spark), "model string, start long, session long, status string, at timestamp"

    def arrive(*rows):
        own.createDataFrame([(m, k, s, status, T0 + n * SECOND) for m, k, s, status, n in rows], kind).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(kind).parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
        retries.retries(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        return {(r["model"], r["session"], r["action"], (r["at"] - T0) // SECOND, r["tries"]) for r in own.read.schema(retries.ACTIONS).parquet(f"{tmp_path}/out").collect()}

    assert arrive(("a", 0, 1, "failed", 0), ("b", 0, 1, "failed", 5)) == set()
    first = {("a", 1, "retry", 60, 1)}
    assert arrive(("c", 0, 1, "running", 62)) == first  # a is due, b is not
    assert arrive(("b", 0, 2, "failed", 63)) == first  # a new session: b's retry of 65 is forgotten
    second = first | {("a", 1, "failed", 102, 3), ("c", 1, "completed", 103, 0)}
    assert arrive(("a", 0, 1, "failed", 101), ("a", 0, 1, "failed", 102), ("c", 0, 1, "completed", 103)) == second
    assert arrive(("c", 0, 1, "failed", 130)) == second | {("b", 2, "retry", 123, 1)}


def test_counts_of_a_stream_equal_a_batch(spark, tmp_path):
    kind, dice = "model string, category string, subcategory string", random.Random(1)
    rows = [(dice.choice("mn"), dice.choice("ab"), dice.choice("xyz")) for _ in range(300)]
    keys, counts = ["model", "category", "subcategory"], f"{tmp_path}/counts"
    stream = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], kind).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.keep_label_counts(stream(), keys, counts, f"{tmp_path}/at").awaitTermination()
    # the last batch again, as after a crash before its commit
    commits = sorted((tmp_path / "at/commits").glob("[0-9]*"))
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()
    ingest.keep_label_counts(stream(), keys, counts, f"{tmp_path}/at").awaitTermination()
    got = {tuple(r[k] for k in keys): r["n_labels"] for r in ingest.label_totals(spark, counts, keys).collect()}
    assert got == {k: rows.count(k) for k in set(rows)}
