"""Influence over a weighted directed graph by the independent cascade model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import Rounds

#: So many cascades share one 64-bit word of a node.
WORD = 60


def influence(edges: DataFrame, seeds: DataFrame, steps: int = 3, threshold: float = 0.3, runs: int = 60, seed: int = 42) -> DataFrame:
    """id, step, share: nodes that cascades from seeds (id) reach, the first step that reaches each in any run, and in which share of the runs it is reached.

    An edge (source_id, target_id, weight; 0.5 if null) is live in a run with
    the chance min(weight, 1), if that is at least threshold; which it is, is
    told by a hash of the seed, the edge and the run, so results are the same
    in every run of the job and on every machine. In a step, all nodes that the
    step before reached hand their runs on over live edges; runs are bits of
    words, so all cascades go on at once. Of edges that share their ends the
    greatest weight holds. Seeds that no edge names are reached and reach nothing.
    """
    rounds = Rounds(edges.sparkSession)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.5))
    ties = edges.filter("source_id is not null and target_id is not null").groupBy("source_id", "target_id").agg(F.max(weight).alias("w")).withColumn("w", F.least("w", F.lit(1.0))).filter((F.col("w") >= threshold) & (F.col("source_id") != F.col("target_id")))
    words = -(-runs // WORD)
    chance = lambda w, b: (F.pmod(F.xxhash64(F.lit(seed), "source_id", "target_id", w, b), F.lit(1 << 30)) / float(1 << 30))
    bit = lambda w: F.aggregate(F.sequence(F.lit(0), F.least(F.lit(WORD), F.lit(runs) - w * WORD) - 1), F.lit(0).cast("long"), lambda s, b: s + F.when(chance(w, b) < F.col("w"), F.expr("1L")).otherwise(F.lit(0).cast("long")) * F.pow(F.lit(2.0), b).cast("long"))
    live = rounds.keep("live", ties.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(words - 1)))).withColumn("live", bit(F.col("word"))).filter("live <> 0").select("source_id", "target_id", "word", "live"))
    full = F.when(F.col("word") < words - 1, (1 << WORD) - 1).otherwise((1 << (runs - WORD * (words - 1))) - 1).cast("long")
    start = seeds.select("id").filter("id is not null").distinct().withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(words - 1)))).withColumn("reached", full)
    seen = rounds.keep("seen-0", start.withColumn("step", F.lit(0)))
    new = seen.select("id", "word", F.col("reached").alias("new"))
    for i in range(1, steps + 1):
        sent = new.join(live, (new["id"] == live["source_id"]) & (new["word"] == live["word"])).select(F.col("target_id").alias("id"), live["word"], F.col("new").bitwiseAND(F.col("live")).alias("got")).filter("got <> 0")
        got = sent.groupBy("id", "word").agg(F.bit_or("got").alias("got"))
        both = seen.join(got, ["id", "word"], "full").select("id", "word", F.coalesce("reached", F.lit(0).cast("long")).alias("old"), F.coalesce("got", F.lit(0).cast("long")).alias("got"), F.coalesce("step", F.lit(i)).alias("step"))
        after = rounds.keep(f"seen-{i % 2 + 1}", both.select("id", "word", F.col("old").bitwiseOR(F.col("got")).alias("reached"), "step", F.col("got").bitwiseAND(F.bitwise_not("old")).alias("new")))
        new = after.filter("new <> 0").select("id", "word", "new")
        seen = after.drop("new")
        if new.isEmpty():
            break
    return seen.groupBy("id").agg(F.min("step").alias("step"), (F.sum(F.bit_count("reached")) / runs).alias("share"))


def reach(found: DataFrame, nodes: int) -> DataFrame:
    """step, activated (mean over the runs of nodes first reached by then, as each node's share), and what part of all nodes that is, to 4 places."""
    return found.groupBy("step").agg(F.sum("share").alias("activated")).withColumn("ratio", F.round(F.col("activated") / F.lit(max(1, nodes)), 4))
