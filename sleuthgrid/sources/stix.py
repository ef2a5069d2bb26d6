"""Threat models in STIX bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = """objects array<struct<type string, id string, name string, revoked boolean, x_mitre_deprecated boolean,
  external_references array<struct<source_name string, external_id string>>,
  relationship_type string, source_ref string, target_ref string>>"""
#: Object types that become nodes, and the edges that are kept.
KINDS = {"x-mitre-tactic": "Tactic", "attack-pattern": "Technique", "intrusion-set": "Group", "course-of-action": "Mitigation", "malware": "Software", "tool": "Software"}
EDGES = ("subtechnique-of", "uses", "mitigates")


def read_bundle(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (attack_id, kind, name) and edges (source_id, target_id, rel_type) of bundles (value: JSON text).

    Revoked and deprecated objects go, and objects without an external id; an
    edge stays if it and both of its ends do. Text that isn't JSON, or null,
    gives no rows.
    """
    o = bundles.select(F.explode(F.from_json("value", SCHEMA)["objects"]).alias("o")).select("o.*")
    live = o.filter(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    ids = F.filter(F.transform("external_references", lambda r: F.when(r["source_name"].startswith("mitre"), r["external_id"])), lambda x: x.isNotNull())
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in KINDS.items()])
    nodes = live.select("id", F.try_element_at(ids, F.lit(1)).alias("attack_id"), kind.alias("kind"), "name").filter("attack_id is not null and kind is not null").dropDuplicates(["id"])
    end = lambda ref, out: nodes.select(F.col("id").alias(ref), F.col("attack_id").alias(out))
    links = live.filter((F.col("type") == "relationship") & F.col("relationship_type").isin(*EDGES))
    edges = links.join(end("source_ref", "source_id"), "source_ref").join(end("target_ref", "target_id"), "target_ref")
    return nodes.drop("id").dropDuplicates(["attack_id"]), edges.select("source_id", "target_id", F.col("relationship_type").alias("rel_type")).distinct()
