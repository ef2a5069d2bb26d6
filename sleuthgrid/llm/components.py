"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected(ws: Workspace, edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """id, comp (smallest id of its component) of every id in edges (x, y).

    In turn, every node hands its larger neighbours, then its smaller ones, to
    the smallest of them; the number of rounds grows with the logarithm of the
    longest path. A node's neighbours are never gathered: the smallest is an
    aggregate that is joined back. Raises if most rounds don't do.
    """
    now = ws.write(edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), f"{name}-cc-0", small=True)
    for i in range(1, most + 1):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y").filter("x <> y").distinct()
        after = ws.write(small, f"{name}-cc-{i}", small=True)
        # settled once every node points at one that points nowhere
        ends = after.select(F.inline(F.array(F.struct(F.col("x").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("y").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))))
        busy = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("`out` > 1 or `out` = 1 and `into` = 1").limit(1).count()
        ws.drop(f"{name}-cc-{i - 1}")
        now = after
        if not busy:
            break
    else:
        raise RuntimeError(f"components haven't settled after {most} rounds")
    now = ws.write(now, f"{name}-cc", small=True)
    ws.drop(f"{name}-cc-{i}")
    return now.select(F.col("x").alias("id"), F.col("y").alias("comp")).unionByName(now.select(F.col("y").alias("id"), F.col("y").alias("comp")).distinct())
