"""Ranks within keys of which one may hold most rows, and dense names of distinct keys.

Rows are dealt by ranges of (key, order), so a large key lies in several tasks.
A task numbers its own rows of each key; only keys that go on from one task to
the next, of which there are fewer than tasks, need what came before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, partitions

#: Names are dealt into so many buckets, each of which is numbered on its own.
BUCKETS = 1024


def _number(key: str):
    def run(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy()
            starts = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
            local = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
            if last == k[0]:
                local[: starts[1] if len(starts) > 1 else len(k)] += seen
            last, seen = k[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), part)), pa.array(local)], [*batch.schema.names, "_part", "_local"])

    return run


def ranked(ws: Workspace, rows: DataFrame, key: str, order: list[str], name: str, alias: str = "rank") -> DataFrame:
    """Add each row's rank from 1 within key (a long, never null) by order; rows that are equal in all of it may change places.

    rows should be a written table: it is read once for the bounds of ranges and once for the rows.
    """
    fields = rows.schema
    out = T.StructType([*fields.fields, T.StructField("_part", T.LongType()), T.StructField("_local", T.LongType())])
    salted = rows.withColumn("_row", F.monotonically_increasing_id())  # splits rows that are equal
    dealt = salted.repartitionByRange(partitions(ws.spark), key, *order, "_row").sortWithinPartitions(key, *order).drop("_row")
    dealt = ws.write(dealt.mapInArrow(_number(key), out), name)
    edge = dealt.groupBy("_part").agg(F.max(key).alias(key))  # one row a task
    crossing = dealt.join(F.broadcast(edge.select(key).distinct()), key, "left_semi").groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = crossing.withColumn("_before", F.sum("_n").over(w)).filter("_before > 0").drop("_n")
    joined = dealt.join(F.broadcast(before), [key, "_part"], "left")
    return joined.withColumn(alias, F.col("_local") + 1 + F.coalesce("_before", F.lit(0))).select(*fields.names, alias)


def dense_names(ws: Workspace, rows: DataFrame, keys: list[str], name: str, alias: str = "name") -> DataFrame:
    """Distinct keys, each with a number from 0 without gaps and in n how many rows have it."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    found = ws.write(found, f"{name}-distinct")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
    first = found.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    out = ws.write(found.withColumn("_local", local).join(F.broadcast(first), "_b").select(*keys, "n", (F.col("_first") + F.col("_local")).alias(alias)), f"{name}-names")
    ws.drop(f"{name}-distinct")
    return out
