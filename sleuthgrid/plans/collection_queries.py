"""Queries of projects, collection, requirements and timelines, over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import collection as co
from ..operators import graph as g
from .catalog import query
from .model import ENTITIES, RELATIONSHIPS, entities, relationships, table


@query(
    "a2_project_counts",
    """WITH e AS (SELECT 'C' || c_custkey AS id, c_nationkey AS p, CASE WHEN c_custkey % 10 = 0 THEN 'Document' WHEN c_custkey % 10 = 1 THEN 'Project' ELSE 'Person' END AS t FROM customer UNION ALL SELECT 'S' || s_suppkey, s_nationkey, 'Organization' FROM supplier),
    r AS (SELECT DISTINCT 'C' || o_custkey AS s, 'S' || l_suppkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey), l AS (SELECT a.p, count(*) AS n FROM r JOIN e a ON a.id = s JOIN e b ON b.id = r.t WHERE a.p = b.p GROUP BY 1)
    SELECT n_nationkey + 1 AS id, coalesce(m.n, 0) AS n_entities, coalesce(m.k, 0) AS n_documents, coalesce(l.n, 0) AS n_edges FROM nation LEFT JOIN (SELECT p, count(*) AS n, count(*) FILTER (t = 'Document') AS k FROM e WHERE t <> 'Project' GROUP BY 1) m ON m.p = n_nationkey + 1 LEFT JOIN l ON l.p = n_nationkey + 1""",
)
def a2(spark, d):
    kind = F.when(F.col("c_custkey") % 10 == 0, "Document").when(F.col("c_custkey") % 10 == 1, "Project").otherwise("Person")
    e = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("project_id"), kind.alias("entity_type"))
    e = e.union(table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), "s_nationkey", F.lit("Organization")))
    r = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id")).distinct()
    return co.project_counts(table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("id")), e, r)


@query(
    "a16_source_health",
    "SELECT o_custkey AS source, count(*) AS attempts, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(coalesce(sum(o_orderkey % 50) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS records, max(o_orderdate) FILTER (o_orderstatus <> 'F') AS last_success FROM orders GROUP BY 1",
)
def a16(spark, d):
    return co.source_health(table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderstatus") != "F").alias("ok"), (F.col("o_orderkey") % 50).alias("records"), F.col("o_orderdate").alias("at")))


_STATUS = "CASE l_linestatus || l_returnflag WHEN 'FR' THEN 'satisfied' WHEN 'FA' THEN 'PARTIAL' WHEN 'ON' THEN CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity > 20 THEN 'Satisfied' ELSE 'UNMET' END ELSE 'OPEN' END"


@query(
    "a20_roll_up",
    f"""WITH r AS (SELECT l_orderkey AS pir_id, upper(coalesce({_STATUS}, 'UNASSESSED')) AS s FROM lineitem) SELECT pir_id, CASE WHEN bool_and(s = 'SATISFIED') THEN 'SATISFIED' WHEN bool_or(s IN ('SATISFIED', 'PARTIAL')) THEN 'PARTIAL' ELSE 'OPEN' END AS status,
    count(*) FILTER (s = 'SATISFIED') AS n_satisfied, count(*) FILTER (s = 'UNMET') AS n_unmet, count(*) FILTER (s NOT IN ('SATISFIED', 'UNMET')) AS n_pending FROM r GROUP BY 1""",
)
def a20(spark, d):
    return co.roll_up(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pir_id"), F.expr(_STATUS.replace("l_linestatus || l_returnflag", "concat(l_linestatus, l_returnflag)")).alias("status")))


@query(
    "j29_reconcile",
    """WITH s AS (SELECT c_custkey AS pir_id, c_nationkey AS ordinal, c_name AS text, c_mktsegment AS state FROM customer WHERE c_custkey % 5 <> 0), w AS (SELECT c_custkey AS pir_id, c_nationkey AS ordinal, CASE WHEN c_custkey % 4 = 0 THEN lower(c_name) ELSE c_name END AS text FROM customer WHERE c_custkey % 7 <> 0)
    SELECT pir_id, ordinal, coalesce(w.text, s.text) AS text, CASE WHEN s.text IS NULL OR w.text <> s.text THEN 'pending' ELSE state END AS state, CASE WHEN s.text IS NULL THEN 'insert' WHEN w.text IS NULL THEN 'delete' WHEN w.text <> s.text THEN 'reset' ELSE 'keep' END AS action FROM s FULL JOIN w USING (pir_id, ordinal)""",
)
def j29(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("pir_id"), F.col("c_nationkey").alias("ordinal"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("state"))
    changed = F.when(F.col("pir_id") % 4 == 0, F.lower("text")).otherwise(F.col("text"))
    return co.reconcile(c.filter("pir_id % 5 <> 0"), c.filter("pir_id % 7 <> 0").select("pir_id", "ordinal", changed.alias("text")), ["pir_id", "ordinal"])


@query("l8_latest", "SELECT * FROM (SELECT user_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 5")
def l8(spark, d):
    return co.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)


@query("l9_timeline", "SELECT id, name, coalesce(event_at, created_at) AS \"at\", CASE WHEN event_at IS NULL THEN 'entity_created' ELSE 'event' END AS kind FROM (SELECT event_id AS id, event_type AS name, CASE WHEN event_id % 3 = 0 THEN ts END AS event_at, ts - INTERVAL 1 DAY AS created_at FROM events ORDER BY name, id LIMIT 500) ORDER BY \"at\" DESC, id")
def l9(spark, d):
    return co.timeline(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("event_at"), (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("created_at")))


_BRANCHES = """t AS (SELECT 'C' || c_custkey AS id, TIMESTAMP '2020-01-01' AS "at", 'created' AS kind FROM customer UNION ALL SELECT 'C' || o_custkey, o_orderdate, 'relationship' FROM orders UNION ALL SELECT 'O' || o_orderkey, o_orderdate, 'relationship' FROM orders
UNION ALL SELECT 'O' || o_orderkey, o_orderdate + INTERVAL 2 DAY, 'event' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'O' || l_orderkey, l_shipdate, 'document' FROM lineitem)"""


def _branches(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("oid"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cid"), "o_orderdate", "o_orderkey")
    none = F.lit(None).cast("timestamp_ntz")
    e = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.expr("TIMESTAMP_NTZ'2020-01-01'").alias("created_at"), none.alias("event_at"))
    e = e.unionByName(o.select(F.col("oid").alias("id"), none.alias("created_at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 2 DAY")).alias("event_at")))
    mentions = table(spark, d, "lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_shipdate").alias("at"))
    return co.entity_timeline(e, o.select(F.col("cid").alias("source_id"), F.col("oid").alias("target_id"), F.col("o_orderdate").alias("seen")), mentions)


@query("d7_entity_timeline", f"WITH {_BRANCHES} SELECT id, \"at\", kind FROM t")
def d7(spark, d):
    return _branches(spark, d)


@query("a10_daily", f"WITH {_BRANCHES} SELECT id, strftime(\"at\", '%Y-%m-%d') AS day, count(*) AS n, min(min(\"at\")) OVER (PARTITION BY id) AS first, max(max(\"at\")) OVER (PARTITION BY id) AS last FROM t GROUP BY 1, 2")
def a10(spark, d):
    return co.daily(_branches(spark, d))


@query("w7_latest_time", "SELECT user_id, max(ts) AS latest FROM events GROUP BY 1")
def w7(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("latest"))


@query("w9_reserves", "SELECT p_partkey, greatest(1, CAST(floor(p_size * 0.3) AS BIGINT)) AS reserve, greatest(1, p_size - greatest(1, CAST(floor(p_size * 0.3) AS BIGINT))) AS planned, greatest(1, p_size // greatest(1, p_partkey % 7)) AS share FROM part")
def w9(spark, d):
    reserve, planned = co.source_reserve(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", reserve.cast("long").alias("reserve"), planned.cast("long").alias("planned"), co.fair_share(F.col("p_size"), F.col("p_partkey") % 7).cast("long").alias("share"))


@query("w5_skipping", "SELECT l_orderkey, CAST(list_reduce(list_prepend(0::BIGINT, list(CAST(floor(l_quantity) AS BIGINT) ORDER BY l_linenumber, floor(l_quantity))), lambda acc, x: CASE WHEN acc + x <= 70 THEN acc + x ELSE acc END) AS BIGINT) AS used FROM lineitem GROUP BY 1")
def w5(spark, d):
    return co.pack_skipping(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("long").alias("q")), ["l_orderkey"], ["l_linenumber"], "q", 70).select("l_orderkey", "used")


@query("w11_labels", f"WITH rel AS ({RELATIONSHIPS}), d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY 1) SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 40")
def w11(spark, d):
    return g.degree(relationships(spark, d)).filter("degree > 0").select("id", "degree").orderBy(F.desc("degree"), "id").limit(40)


@query("l4_evidence", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem ORDER BY l_linenumber % 2 = 0, l_tax DESC, l_orderkey, l_linenumber LIMIT 40")
def l4(spark, d):
    return table(spark, d, "lineitem").orderBy(F.col("l_linenumber") % 2 == 0, F.desc("l_tax"), "l_orderkey", "l_linenumber").limit(40).select("l_orderkey", "l_linenumber", "l_tax")


@query("j2_keyed_neighbours", f"WITH rel AS ({RELATIONSHIPS}), u AS (SELECT source_id AS anchor, target_id AS other FROM rel UNION ALL SELECT target_id, source_id FROM rel WHERE source_id <> target_id) SELECT anchor, count(*) AS n, array_to_string(list_sort(list(other)), ',') AS others FROM u JOIN (SELECT 'S' || s_suppkey AS id FROM supplier WHERE s_suppkey % 9 = 0) k ON k.id = anchor GROUP BY 1")
def j2(spark, d):
    ids = table(spark, d, "supplier").filter("s_suppkey % 9 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("anchor"))
    near = g.undirected(relationships(spark, d)).join(ids, "anchor")
    return near.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))


@query(
    "j6_endpoints",
    f"WITH ent AS ({ENTITIES}), k AS (SELECT lower(name) AS name, min(id) AS id FROM ent GROUP BY 1), e AS (SELECT c_custkey, ' ' || upper(c_name) AS s, CASE WHEN c_custkey % 3 = 0 THEN 'no such' ELSE n_name END AS t FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT c_custkey, a.id AS source_id, b.id AS target_id, a.id IS NOT NULL AND b.id IS NOT NULL AS resolved FROM e LEFT JOIN k a ON a.name = lower(trim(s)) LEFT JOIN k b ON b.name = lower(t)",
)
def j6(spark, d):
    e = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    e = e.select("c_custkey", F.concat(F.lit(" "), F.upper("c_name")).alias("source_name"), F.when(F.col("c_custkey") % 3 == 0, "no such").otherwise(F.col("n_name")).alias("target_name"))
    return co.by_name(e, entities(spark, d)).select("c_custkey", "source_id", "target_id", "resolved")


@query(
    "u2_merged_entities",
    """WITH r AS (SELECT 0 AS k, p_name AS name, p_brand AS entity_type, p_size / 50 AS confidence FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1, upper(p_name), p_type, p_size / 60 FROM part WHERE p_partkey % 3 = 0)
    SELECT name, entity_type, confidence, n_methods FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY k, confidence DESC, name, entity_type) AS r, (SELECT count(DISTINCT q.k) FROM r q WHERE lower(q.name) = lower(r.name)) AS n_methods FROM r) WHERE r = 1""",
)
def u2(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"), (F.col("p_size") / 50).alias("confidence"))
    b = p.filter("p_partkey % 3 = 0").select(F.upper("p_name").alias("name"), F.col("p_type").alias("entity_type"), (F.col("p_size") / 60).alias("confidence"))
    return co.merge_entities(a, b)


@query("u4_methods", "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT m)), ',') AS methods FROM (SELECT l_partkey, l_returnflag AS m FROM lineitem UNION ALL SELECT l_partkey, l_linestatus FROM lineitem) GROUP BY 1")
def u4(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    both = F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus"))
    return l.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("methods"))


@query("a26_connections", "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def a26(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


@query("p19_weak_edges", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' AND 1 - l_discount * 5 < 0.55)")
def p19(spark, d):
    weak = (F.col("l_returnflag") == "R") & (1 - F.col("l_discount") * 5 < 0.55)  # the returned stand for the loosest relation
    return table(spark, d, "lineitem").filter(~weak).select("l_orderkey", "l_linenumber")


@query("f25_headed_records", "SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || o_orderpriority || chr(10) || 'status: ' || o_orderstatus || '.' AS text FROM orders")
def f25(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    return o.select("o_orderkey", F.concat_ws("\n", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "o_orderpriority", tx.record_text("status")).alias("text"))
