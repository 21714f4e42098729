"""Ranges that wait in groups."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from corpuscle.streaming import retries

T0 = datetime(2024, 1, 1)
SECOND = timedelta(seconds=1)
KIND = "model string, start long, session long, status string, at timestamp"


def test_groups_keep_states_and_every_range_its_own_clock(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retries, "GROUPS", 8, raising=False)
    own, dice = retries.timer_session(spark), random.Random(5)
    models = [*(f"m{i}" for i in range(60)), None, "é"]
    rows = [(dice.choice(models), dice.choice([0, 100, 2**60 + 1, None]), 1 + n // 300, dice.choice(["failed", "failed", "running", "completed"]), n) for n in range(600)]
    rows += [("last", 0, 2, "failed", 600), ("clock", 0, 2, "running", 660)]  # due as the clock strikes
    want, states = [], defaultdict(lambda: (0, 0, False, None))
    for m, k, session, status, n in rows:
        states[m, k], told = retries.step(states[m, k], session, status, n, 60)
        want += [(m, k, *t) for t in told]
    want += [(m, k, session, "retry", due, tries) for (m, k), (session, tries, _, due) in states.items() if due is not None and due <= 660]
    for part in (rows[:200], rows[200:500], rows[500:]):
        own.createDataFrame([(m, k, s, status, T0 + n * SECOND) for m, k, s, status, n in part], KIND).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(KIND).parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
        told = retries.retries(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at")
        query = told.trigger(availableNow=True).start()
        query.awaitTermination()
    found = own.read.schema(retries.ACTIONS).parquet(f"{tmp_path}/out").collect()
    got = [(r["model"], r["start"], r["session"], r["action"], (r["at"] - T0) // SECOND, r["tries"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ("last", 0, 2, "retry", 660, 1) in got
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 8 < len(states)
