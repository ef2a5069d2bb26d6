"""Queries of entity resolution and of techniques, with parts as techniques, brands as their parents and suppliers as mitigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution as rs
from ..operators import threats as th
from .catalog import query
from .model import table

_TYPED = "CASE WHEN p_partkey % 6 = 0 THEN 'Domain' WHEN p_partkey % 6 = 1 THEN 'Ship' ELSE 'Person' END"
_ASKED = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, 's') WHEN 2 THEN replace(p_name, 'e', 'ee') WHEN 3 THEN split_part(p_name, ' ', 2) ELSE concat(' ', p_name) END"


@query(
    "j7_resolution",
    rf"""WITH e AS (SELECT min(p_partkey) AS position, p_name AS match, CASE WHEN p_name < 'm' THEN 'Person' WHEN p_name < 'q' THEN 'Domain' ELSE 'Ship' END AS kind FROM part GROUP BY 2), n AS (SELECT DISTINCT {_ASKED} AS name, {_TYPED} AS entity_type FROM part),
    p AS (SELECT n.name, entity_type, match, kind, position, lower(trim(n.name)) AS a, lower(trim(match)) AS b, jaro_winkler_similarity(lower(trim(n.name)), lower(trim(match))) AS jw FROM n, e),
    t AS (SELECT *, CASE WHEN a = b AND (entity_type = 'Domain' OR entity_type = kind AND kind <> 'Domain') THEN 0 WHEN entity_type = 'Domain' OR kind = 'Domain' THEN NULL WHEN entity_type = kind AND jw >= 0.92 THEN 1
    WHEN entity_type = 'Person' AND least(length(a), length(b)) >= 4 AND least(length(a), length(b)) / greatest(length(a), length(b)) > 0.3 AND CASE WHEN length(a) <= length(b) THEN regexp_matches(b, '\b' || a || '\b') ELSE regexp_matches(a, '\b' || b || '\b') END THEN 2 END AS tier FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY name, entity_type ORDER BY tier, CASE WHEN tier = 1 THEN -jw ELSE 0 END, position) AS r FROM t WHERE tier IS NOT NULL)
    SELECT n.name, n.entity_type, match, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'part' END AS rule FROM n LEFT JOIN (SELECT * FROM r WHERE r = 1) r ON r.name = n.name AND r.entity_type = n.entity_type""",
)
def j7(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("name") < "m", "Person").when(F.col("name") < "q", "Domain").otherwise("Ship")
    existing = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("position")).withColumn("entity_type", kind)
    asked = p.select(F.expr(_ASKED).alias("name"), F.expr(_TYPED).alias("entity_type"))
    return rs.resolve(asked, existing).drop("score")


@query("x3_batch_merge")
def x3(spark, d):
    """Variants of product names as a batch, against the names of every third product. No SQL; tests/test_resolution.py holds the operators against all pairs."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 6 == 0, "Date").when(F.col("p_partkey") % 6 == 1, "Ship").otherwise("Person")
    batch = p.select(F.col("p_partkey").alias("position"), F.expr(_ASKED).alias("name"), kind.alias("entity_type"), (F.col("p_partkey") % 50 == 3).alias("filtered"), (F.col("p_partkey") % 4 == 0).alias("absorbed"))
    graph = p.filter("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("position")).select("name", F.lit("Person").alias("entity_type"), "position", F.concat(F.lit("P"), F.col("position").cast("string")).alias("id"))
    return rs.merge_batch(batch, graph)


_OBSERVED = "SELECT l_partkey AS t, CASE l_returnflag WHEN 'R' THEN 'regex' WHEN 'A' THEN 'model' ELSE 'tcode' END AS m FROM lineitem WHERE l_quantity >= 45"


def _observed(spark, d):
    method = F.when(F.col("l_returnflag") == "R", "regex").when(F.col("l_returnflag") == "A", "model")
    return table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").cast("string").alias("technique_id"), method.alias("method"))


@query("a12_observed", f"SELECT CAST(t AS VARCHAR) AS technique_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT m)), ',') AS methods FROM ({_OBSERVED}) GROUP BY 1")
def a12(spark, d):
    return th.observed_counts(_observed(spark, d)).withColumn("methods", F.array_join("methods", ","))


@query(
    "a13_matrix",
    f"""WITH o AS ({_OBSERVED}), k AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS parent_id FROM part UNION ALL SELECT DISTINCT p_brand, NULL FROM part), c AS (SELECT id, parent_id, (SELECT count(*) FROM o WHERE CAST(t AS VARCHAR) = id) AS n FROM k),
    m AS (SELECT CAST(t AS VARCHAR) AS id, m FROM o UNION ALL SELECT p_brand, m FROM o JOIN part ON p_partkey = t)
    SELECT c.id, c.parent_id, n AS n_direct, CAST(n + coalesce((SELECT sum(s.n) FROM c s WHERE s.parent_id = c.id), 0) AS BIGINT) AS n_rolled_up, coalesce((SELECT array_to_string(list_sort(list(DISTINCT m)), ',') FROM m WHERE m.id = c.id), '') AS methods FROM c""",
)
def a13(spark, d):
    p = table(spark, d, "part")
    techniques = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("parent_id")).union(p.select("p_brand", F.lit(None).cast("string")).distinct())
    return th.matrix(techniques, _observed(spark, d)).withColumn("methods", F.array_join("methods", ","))


@query("a15_mitigations", "SELECT l_suppkey AS mitigation_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a15(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("mitigation_id"), F.col("l_partkey").cast("string").alias("technique_id"))
    return th.key_mitigations(m, _observed(spark, d))


_CWES = "CASE p_partkey % 5 WHEN 0 THEN concat('[\"CWE-', p_size, '\", \"CWE-', p_size, '\"]') WHEN 1 THEN concat('cwe-', p_size) WHEN 2 THEN concat('CWE-', p_size, ',CWE-', p_size + 1, ' junk') WHEN 3 THEN 'none' END"


@query(
    "j17_enabled",
    f"""WITH v AS (SELECT p_partkey AS id, {_CWES} AS c FROM part), w AS (SELECT DISTINCT id, 'CWE-' || unnest(regexp_extract_all(c, '(?i)cwe-(\\d+)', 1)) AS cwe_id FROM v)
    SELECT DISTINCT id, cwe_id, 'T' || s_nationkey AS technique_id FROM w JOIN supplier ON 'CWE-' || (s_suppkey % 60) = cwe_id""",
)
def j17(spark, d):
    weak = table(spark, d, "supplier").select(F.concat(F.lit("CWE-"), (F.col("s_suppkey") % 60).cast("string")).alias("cwe_id"), F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("technique_id"))
    return th.enabled_by(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_CWES).alias("cwe_ids")), weak)


@query("j18_coded", r"SELECT DISTINCT doc_id AS id, c AS technique_id FROM (SELECT doc_id, unnest(regexp_extract_all(concat(text, ' uses T', 1000 + doc_id % 90, ' and T', 1000 + doc_id % 70, '.001.'), '\bT\d{4}(?:\.\d{3})?\b')) AS c FROM documents WHERE text IS NOT NULL) JOIN (SELECT 'T' || (1000 + s_suppkey % 80) AS k FROM supplier UNION SELECT 'T' || (1000 + s_suppkey % 50) || '.001' FROM supplier) ON k = c")
def j18(spark, d):
    text = F.concat("text", F.lit(" uses T"), (1000 + F.col("doc_id") % 90).cast("string"), F.lit(" and T"), (1000 + F.col("doc_id") % 70).cast("string"), F.lit(".001."))
    s = table(spark, d, "supplier")
    code = lambda m, tail: s.select(F.concat(F.lit("T"), (1000 + F.col("s_suppkey") % m).cast("string"), F.lit(tail)).alias("id"))
    return th.coded(table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text")), code(80, "").union(code(50, ".001")).distinct())


@query(
    "j18_groups",
    """WITH g AS (SELECT 'G' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS id, s_name AS name, 'alias ' || (s_suppkey % 40) AS alias FROM supplier), a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Actor G' || lpad(CAST(c_custkey % 150 AS VARCHAR), 4, '0') WHEN 1 THEN ' ALIAS ' || (c_custkey % 60) WHEN 2 THEN upper(replace(c_name, 'Customer', 'Supplier')) ELSE c_name END AS name FROM customer),
    m AS (SELECT a.id, 0 AS k, g.id AS gid FROM a JOIN g ON g.id = regexp_extract(a.name, 'G[0-9]{4}') UNION ALL SELECT a.id, 1, g.id FROM a JOIN g ON lower(trim(a.name)) IN (lower(g.name), lower(g.alias)))
    SELECT id, arg_min(gid, (k, gid)) AS group_id, CASE min(k) WHEN 0 THEN 'code' ELSE 'name' END AS "by" FROM m GROUP BY 1""",
)
def j18_groups(spark, d):
    pad = lambda c: F.lpad(F.expr(c).cast("string"), 4, "0")
    groups = table(spark, d, "supplier").select(F.concat(F.lit("G"), pad("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias "), (F.col("s_suppkey") % 40).cast("string"))).alias("aliases"))
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Actor G"), pad("c_custkey % 150"))).when(k % 4 == 1, F.concat(F.lit(" ALIAS "), (k % 60).cast("string"))).when(k % 4 == 2, F.upper(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")))).otherwise(F.col("c_name"))
    return th.actor_groups(table(spark, d, "customer").select(k.alias("id"), name.alias("name")), groups)


@query(
    "j12_detail",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') FROM lineitem WHERE l_partkey = p_partkey), '') AS groups, coalesce((SELECT array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48), '') AS flags FROM part""",
)
def j12(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    part = l.select(F.col("l_partkey").cast("string").alias("technique_id"), F.col("l_suppkey").cast("string").alias("value"))
    flags = l.filter("l_quantity > 48").select(F.col("l_partkey").cast("string").alias("technique_id"), F.col("l_returnflag").alias("value"))
    out = th.technique_detail(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id")), {"groups": part, "flags": flags})
    return out.withColumn("groups", F.array_join("groups", ",")).withColumn("flags", F.array_join("flags", ","))
