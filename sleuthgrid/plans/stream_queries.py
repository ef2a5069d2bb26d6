"""The event log replayed as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state as st
from . import queries  # noqa: F401  registers a17_run_state
from .catalog import ORACLES, query
from .model import table


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/event[s].parquet")  # a pattern, so that it may be one file or a folder


@query("t4_run_states", ORACLES["a17_run_state"])
def t4(spark, d):
    """The same rows as a17_run_state gives of the whole log: each plan's last change."""
    rows = st.replay(st.run_states(_stream(spark, d), "user_id", "event_type", "ts", "event_id", final=("purchase",)), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("state", "last_event"), F.struct("_batch", "last_at")).alias("x"))
    return last.select("user_id", "x.state", "x.last_event")


@query(
    "t10_sessions",
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS new FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k)
    SELECT * FROM g WHERE date_trunc('millisecond', "end") <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
)
def t10(spark, d):
    rows = st.replay(st.sessions(_stream(spark, d), "user_id", "ts", unique="event_id"), "append").drop("_batch")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
