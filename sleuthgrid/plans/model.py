"""Entities, relationships and chunks as read from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, entity_type: nations are locations, customers persons, suppliers organizations, parts products."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    kind = lambda k: F.lit(k).alias("entity_type")
    out = t("nation").select(key("N", "n_nationkey"), F.col("n_name").alias("name"), kind("Location"))
    out = out.union(t("customer").select(key("C", "c_custkey"), F.col("c_name"), kind("Person")))
    out = out.union(t("supplier").select(key("S", "s_suppkey"), F.col("s_name"), kind("Organization")))
    return out.union(t("part").select(key("P", "p_partkey"), F.col("p_name"), kind("Product")))


ENTITIES = """
  SELECT 'N' || n_nationkey AS id, n_name AS name, 'Location' AS entity_type FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'Person' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Organization' FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 'Product' FROM part"""


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, rel_type: who is in which nation, and who supplies which part (once for each pair)."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c, a: F.concat(F.lit(p), F.col(c).cast("string")).alias(a)
    kind = lambda k: F.lit(k).alias("rel_type")
    out = t("customer").select(key("C", "c_custkey", "source_id"), key("N", "c_nationkey", "target_id"), kind("LOCATED_IN"))
    out = out.union(t("supplier").select(key("S", "s_suppkey", "source_id"), key("N", "s_nationkey", "target_id"), kind("LOCATED_IN")))
    return out.union(t("lineitem").select(key("S", "l_suppkey", "source_id"), key("P", "l_partkey", "target_id"), kind("SUPPLIES")).distinct())


RELATIONSHIPS = """
  SELECT 'C' || c_custkey AS source_id, 'N' || c_nationkey AS target_id, 'LOCATED_IN' AS rel_type FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey, 'SUPPLIES' FROM lineitem"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge assertions in order: each line of an order says that a supplier supplies a part; a returned line denies it. Some have no document, polarity or evidence."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"),
        F.col("l_partkey").alias("target_id"),
        F.lit("SUPPLIES").alias("rel_type"),
        F.round(1 - F.col("l_discount") * 5, 2).alias("confidence"),
        F.when(F.col("l_orderkey") % 7 == 0, "").otherwise(F.col("l_orderkey").cast("string")).alias("source_doc_id"),
        F.when(F.col("l_returnflag") == "R", "Denies").when(F.col("l_returnflag") == "A", "ASSERTS").alias("polarity"),
        F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).otherwise("").alias("evidence"),
        F.col("l_shipdate").alias("seen"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )
