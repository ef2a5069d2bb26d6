"""Techniques of a threat model against what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = r"\bT\d{4}(?:\.\d{3})?\b"
CWE = r"(?i)\bCWE-(\d+)\b"


def observed_counts(observed: DataFrame) -> DataFrame:
    """technique_id, n, methods: how often each technique was observed (technique_id, method; null is tcode) and by which methods."""
    return observed.groupBy("technique_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.coalesce("method", F.lit("tcode")))).alias("methods"))


def matrix(techniques: DataFrame, observed: DataFrame) -> DataFrame:
    """id, parent_id, n_direct, n_rolled_up, methods of techniques (id, parent_id): what was observed of each, and with all of its sub-techniques."""
    direct = observed_counts(observed).withColumnRenamed("technique_id", "id")
    own = techniques.join(direct, "id", "left").select("id", "parent_id", F.coalesce("n", F.lit(0)).alias("n_direct"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))
    subs = own.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum("n_direct").alias("below"), F.array_distinct(F.flatten(F.collect_set("methods"))).alias("sub_methods"))
    out = own.join(subs, "id", "left")
    methods = F.array_sort(F.array_union("methods", F.coalesce("sub_methods", F.array().cast("array<string>"))))
    return out.select("id", "parent_id", "n_direct", (F.col("n_direct") + F.coalesce("below", F.lit(0))).alias("n_rolled_up"), methods.alias("methods"))


def key_mitigations(mitigates: DataFrame, observed: DataFrame, most: int = 10) -> DataFrame:
    """mitigation_id, n: the mitigations of the most different observed techniques, ties by id."""
    seen = observed.select("technique_id").distinct()
    return mitigates.join(seen, "technique_id", "left_semi").groupBy("mitigation_id").agg(F.count_distinct("technique_id").alias("n")).orderBy(F.desc("n"), "mitigation_id").limit(most)


def enabled_by(vulnerabilities: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """id, cwe_id, technique_id: the techniques that vulnerabilities (id, cwe_ids in any text form) make possible by way of weaknesses (cwe_id, technique_id), once each."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all("cwe_ids", F.lit(CWE), 1), lambda x: F.concat(F.lit("CWE-"), x)))
    return vulnerabilities.select("id", F.explode(ids).alias("cwe_id")).join(weaknesses, "cwe_id").select("id", "cwe_id", "technique_id").distinct()


def coded(texts: DataFrame, techniques: DataFrame) -> DataFrame:
    """id, technique_id of texts (id, text) that name a known technique by its code."""
    codes = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({CODE})"), 1))).alias("technique_id"))
    return codes.join(techniques.select(F.col("id").alias("technique_id")), "technique_id", "left_semi").select("id", "technique_id")


def actor_groups(actors: DataFrame, groups: DataFrame) -> DataFrame:
    """id, group_id, by: the group (id, name, aliases) of each actor (id, name), by a code in its name, or else by name or alias without case; of several the smallest id."""
    low = lambda c: F.lower(F.trim(c))
    code = F.regexp_extract("name", r"\b(G\d{4})\b", 1)
    by_code = actors.filter(code != "").select("id", code.alias("group_id")).join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi").select("id", "group_id", F.lit(0).alias("rank"))
    names = groups.select(F.col("id").alias("group_id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    by_name = actors.join(names, low(F.col("name")) == low(F.col("alias"))).select("id", "group_id", F.lit(1).alias("rank"))
    best = by_code.unionByName(by_name).groupBy("id").agg(F.min(F.struct("rank", "group_id")).alias("b"))
    return best.select("id", "b.group_id", F.when(F.col("b.rank") == 0, "code").otherwise("name").alias("by"))


def technique_detail(techniques: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """Techniques (id, ...) with, for each branch (technique_id, value), the sorted different values; each is gathered before it is joined, so branches don't multiply."""
    out = techniques
    for name, rows in branches.items():
        gathered = rows.groupBy(F.col("technique_id").alias("id")).agg(F.array_sort(F.collect_set("value")).alias(name))
        out = out.join(gathered, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(gathered.schema[name].dataType)))
    return out
