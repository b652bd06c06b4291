"""The retry state machine as a stream: state by groups of entity and reason, a timer at the end of each day with failures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.policy import MOST_RETRIES, action, queue_day

#: Groups by hash that pairs of entity and reason are dealt to; a checkpoint keeps the number that it began with.
GROUPS = 1024


def decide(key, batches: Iterator, state) -> Iterator:
    """Adds the days of new failures to the open ones of their pair and decides those that the watermark has passed, in order.

    A group holds many pairs, since a call costs far more than a pair. ``ends`` is a day's end in milliseconds. Rows come
    in Arrow batches of which only distinct days are kept, so a group takes no more memory than its pairs' open days.
    """
    import pandas as pd

    held = {(e, r): (drop_at, tries, dropped, set(days)) for e, r, drop_at, tries, dropped, days in zip(*state.get, strict=True)} if state.exists else {}
    passed = state.getCurrentWatermarkMs()
    for rows in batches:
        fresh = rows.loc[rows["ends"] >= passed, ["entity_id", "reason_code", "drop_at", "ends"]].drop_duplicates()  # the others are late: their day is decided
        for entity, reason, drop_at, end in fresh.itertuples(index=False, name=None):
            held.setdefault((entity, reason), (int(drop_at), 0, False, set()))[3].add(int(end))
    made, first = [], None
    for (entity, reason), (drop_at, tries, dropped, days) in held.items():
        for end in sorted(d for d in days if d < passed):
            if not dropped:
                made.append((entity, reason, end, tries))
                dropped = 0 <= drop_at <= tries
                tries += 1
        left = sorted(d for d in days if d >= passed)
        held[entity, reason] = (drop_at, tries, dropped, left)
        first = min([*left[:1], *([] if first is None else [first])], default=None)
    kept = [(*pair, *one) for pair, one in held.items()]
    state.update(tuple(list(column) for column in zip(*kept, strict=True)) if kept else tuple([] for _ in range(6)))
    if first is not None:
        state.setTimeoutTimestamp(max(first, passed + 1))
    yield pd.DataFrame(made, columns=["entity_id", "reason_code", "ends", "retry_count"])


def retries(fails: DataFrame, late: str = "10 minutes", most: int = MOST_RETRIES) -> DataFrame:
    """entity_id, reason_code, day, retry_count, action, queue_day: a decision for each day on which a pair failed.

    fails is a stream of entity_id, reason_code and the timestamp ts. Failures of one day count once; the day is decided
    when the watermark passes its end, by the number of days decided before. After a DROP nothing follows. Rows without
    an entity or time are left out; without a reason it is UNKNOWN_ERROR. Days that are open when a run ends stay in the
    checkpoint, so that a later run decides them as if there had been one.
    """
    entity = fails.schema["entity_id"].dataType.simpleString()
    given = fails.filter("entity_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    reason = F.coalesce("reason_code", F.lit("UNKNOWN_ERROR"))
    # how many decisions come before the one that drops; -1: none does
    drop_at = F.when(action(reason, F.lit(0), most) == "DROP", 0).when(action(reason, F.lit(most), most) == "DROP", most).otherwise(-1)
    ends = F.unix_millis(F.date_add(F.to_date("ts"), 1).cast("timestamp"))
    rows = given.select("entity_id", reason.alias("reason_code"), drop_at.alias("drop_at"), "ts", ends.alias("ends"))
    grouped = rows.withColumn("dealt", F.pmod(F.xxhash64("entity_id", "reason_code"), F.lit(GROUPS)).cast("int"))
    schema = f"entity_id {entity}, reason_code string, ends bigint, retry_count int"
    state = f"entities array<{entity}>, reasons array<string>, drops array<int>, tries array<int>, dropped array<boolean>, open array<array<bigint>>"
    made = grouped.groupBy("dealt").applyInPandasWithState(decide, schema, state, "append", "EventTimeTimeout")
    day = F.date_sub(F.to_date(F.timestamp_millis("ends")), 1)
    what = action(F.col("reason_code"), F.col("retry_count"), most)
    return made.select("entity_id", "reason_code", day.alias("day"), "retry_count", what.alias("action")).withColumn("queue_day", queue_day(F.col("action"), F.col("day")))
