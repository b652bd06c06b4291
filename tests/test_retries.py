"""The retry stream against its SQL and against one decision after the other, however the failures are cut into batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.operators.policy import LAST_DROP, MOST_RETRIES, RULES
from millrace.plans import streaming_queries
from millrace.streaming import ingest
from millrace.streaming.retries import retries

from .compare import both

SCHEMA = "entity_id bigint, reason_code string, ts timestamp, note string"
START = dt.datetime(2024, 3, 1)


def test_query_equals_sql(spark, sf_dir):
    made, due = both(spark, sf_dir, streaming_queries.retry_stream, streaming_queries.ORACLES["retry_stream"])
    assert made == due and made


def brute(fails, until):
    """One decision a day of each pair, in order of days; days that end at or after ``until`` are open."""
    out, pairs = set(), {}
    for entity, reason, ts, _ in fails:
        if entity is not None and ts is not None:
            pairs.setdefault((entity, reason or "UNKNOWN_ERROR"), set()).add(ts.date())
    for (entity, reason), days in pairs.items():
        for tries, day in enumerate(sorted(days)):
            if dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1) >= until:
                break
            act = RULES.get(reason, "WARN")
            if act == "RETRY" and tries >= MOST_RETRIES:
                act = "DROP" if reason in LAST_DROP else "WARN"
            out.add((entity, reason, day, tries, act, day + dt.timedelta(days=1) if act == "RETRY" else day))
            if act == "DROP":
                break
    return out


def failures(seed):
    pick = random.Random(seed)
    rows = [(pick.choice([1, 1, 1, 2, 3]), pick.choice(["TIMEOUT", "TIMEOUT", "NOT_FOUND", "SELECTOR_MISMATCH", None]), START + dt.timedelta(minutes=pick.randrange(12 * 1440)), "n") for _ in range(120)]
    return sorted([*rows, (1, "TIMEOUT", START + dt.timedelta(days=12, hours=5), "n")], key=lambda r: r[2])


def write(spark, rows, place):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(place)


def run(spark, source, out, state):
    rows = ingest.stream_of(spark, source, spark.createDataFrame([], SCHEMA).schema, per_trigger=1)
    ingest.append(retries(rows), out, state)
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_cuts_and_restarts_change_nothing(spark, tmp_path):
    rows = failures(3)
    due = brute(rows, rows[-1][2] - dt.timedelta(minutes=10))
    assert {r[4] for r in due} == {"RETRY", "DROP", "REPROCESS", "WARN"}
    whole, parts = f"file://{tmp_path}/whole", f"file://{tmp_path}/parts"
    write(spark, rows, whole)
    made = run(spark, whole, f"{whole}-out", f"{whole}-state")
    assert set(made) == due and len(made) == len(due)
    for a, b in ((0, 25), (25, 26), (26, 90), (90, len(rows))):  # each cut is a run of its own, which goes on from the state before
        write(spark, rows[a:b], parts)
        made = run(spark, parts, f"{parts}-out", f"{parts}-state")
    assert set(made) == due and len(made) == len(due)


def test_nulls_and_no_rows(spark, tmp_path):
    place = f"file://{tmp_path}/in"
    write(spark, [], place)
    assert run(spark, place, f"{place}-out", f"{place}-state") == []
    rows = [(None, "TIMEOUT", START, "n"), (1, None, START, None), (1, "TIMEOUT", None, "n"), (2, "TIMEOUT", START, "n"), (2, "TIMEOUT", START, "n"), (3, "OTHER", START + dt.timedelta(days=3), "n")]
    write(spark, rows, place)
    made = run(spark, place, f"{place}-out", f"{place}-state")
    day = START.date()
    assert sorted(made) == [(1, "UNKNOWN_ERROR", day, 0, "WARN", day), (2, "TIMEOUT", day, 0, "RETRY", day + dt.timedelta(days=1))]


def test_one_call_decides_many_pairs():
    """A group holds many pairs with a state of their own; days the watermark hasn't passed stay open."""
    import pandas as pd

    from millrace.streaming.retries import decide

    class State:
        exists, get, timer = False, None, None
        passed = 0

        def getCurrentWatermarkMs(self):
            return self.passed

        def update(self, new):
            self.exists, self.get = True, new

        def setTimeoutTimestamp(self, at):
            self.timer = at

    state, empty = State(), pd.DataFrame({"entity_id": [], "reason_code": [], "drop_at": [], "ends": []})
    rows = pd.DataFrame([(e, "R", 1, end) for e in ("a", "b") for end in (10, 20, 30, 10)] + [("c", "S", 0, 10), ("c", "S", 0, 20)], columns=list(empty.columns))
    assert next(decide((0,), iter([rows]), state)).empty and state.timer == 10
    state.passed = 25
    made = next(decide((0,), iter([empty]), state))
    assert sorted(made.itertuples(index=False, name=None)) == [("a", "R", 10, 0), ("a", "R", 20, 1), ("b", "R", 10, 0), ("b", "R", 20, 1), ("c", "S", 10, 0)]
    assert state.timer == 30 and dict(zip(state.get[0], state.get[5])) == {"a": [30], "b": [30], "c": []}
