"""State machines and sessions over streams of events. All state ends: by timers, or with the watermark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.steps import folder


def _micros(t) -> int:
    return pd.Timestamp(t).value // 1000


def run_states(events: DataFrame, plan: str, event: str, at: str, tie: str, stalled: int = 600, final: tuple[str, ...] = ("completed", "failed"), late: str = "0 seconds") -> DataFrame:
    """plan, state, last_event, last_at, whenever a plan's state changes: its last event if that is final, else running; stalled once the stream's time is more than stalled seconds past it.

    The last event is that of the greatest (at, tie), so events may come in any
    order and more than once until the watermark passes them, which is late
    behind the latest event. A plan is forgotten when its timer runs out; what
    comes later begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            micros, _, last = state.get
            state.remove()
            if last not in final:
                yield pd.DataFrame({plan: [key[0]], "state": ["stalled"], "last_event": [last], "last_at": [pd.Timestamp(micros * 1000)]})
            return
        old = state.get if state.exists else None
        best = old
        for rows in batches:
            for t, k, e in zip(rows["_at"], rows["_tie"], rows["_event"], strict=True):
                found = (_micros(t), int(k), str(e))
                best = found if best is None or found > best else best
        if best is None or best == old:
            return
        state.update(best)
        # the timer runs out when the watermark is over this
        state.setTimeoutTimestamp(max(best[0] // 1000 + stalled * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({plan: [key[0]], "state": [best[2] if best[2] in final else "running"], "last_event": [best[2]], "last_at": [pd.Timestamp(best[0] * 1000)]})

    rows = events.select(plan, F.col(event).alias("_event"), F.col(at).cast("timestamp").alias("_at"), F.col(tie).cast("long").alias("_tie")).filter(f"`{plan}` is not null and _at is not null and _event is not null").withWatermark("_at", late)
    kind = events.schema[plan].dataType.simpleString()
    return rows.groupBy(plan).applyInPandasWithState(step, f"`{plan}` {kind}, state string, last_event string, last_at timestamp", "at long, tie long, event string", "update", GroupStateTimeout.EventTimeTimeout)


def requirement_states(attempts: DataFrame, requirement: str, satisfied: str, at: str, most: int = 2, forget: str = "30 days") -> DataFrame:
    """requirement, state, attempts after each attempt: satisfied for good once one is, unmet from most failed attempts on, else pending. A requirement is forgotten that long after its last attempt."""
    quiet = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tried, met, last = state.get if state.exists else (0, False, 0)
        for rows in batches:
            rows = rows.sort_values("_at")
            for good, t in zip(rows["_good"], rows["_at"], strict=True):
                tried, met, last = tried + (not met), met or bool(good), max(last, _micros(t) // 1000)
        state.update((int(tried), bool(met), int(last)))
        state.setTimeoutTimestamp(max(last + quiet, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({requirement: [key[0]], "state": ["satisfied" if met else "unmet" if tried >= most else "pending"], "attempts": [tried]})

    rows = attempts.select(requirement, F.coalesce(satisfied, F.lit(False)).alias("_good"), F.col(at).cast("timestamp").alias("_at")).filter(f"`{requirement}` is not null and _at is not null").withWatermark("_at", "0 seconds")
    kind = attempts.schema[requirement].dataType.simpleString()
    return rows.groupBy(requirement).applyInPandasWithState(step, f"`{requirement}` {kind}, state string, attempts long", "tried long, met boolean, last long", "update", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str = "0 seconds", unique: str | None = None) -> DataFrame:
    """user, start, end, n of each session: events of a user no more than gap apart, once the watermark has passed its end (start and gap after the last event). unique: a column by which repeated events count once."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).filter("_at is not null").withWatermark("_at", late)
    if unique:
        rows = rows.dropDuplicatesWithinWatermark([unique])
    out = rows.groupBy(user, F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def replay(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table: its rows, and in _batch the number of the batch that gave each."""
    at = f"{folder(stream.sparkSession)}/replay-{uuid.uuid4().hex}"
    out = f"{at}/rows"

    def keep(rows: DataFrame, number: int) -> None:
        # a batch that is tried again writes its own folder again
        rows.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("_batch", "long")
    return stream.sparkSession.read.option("basePath", out).schema(schema).parquet(out)
