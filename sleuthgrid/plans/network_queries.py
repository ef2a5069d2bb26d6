"""Queries of paths, communities, merges, attribution, timelines and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as g
from ..operators import network as nw
from .catalog import query
from .model import entities, relationships, table
from .queries import WITH


def located(spark, d):
    return relationships(spark, d).filter("rel_type = 'LOCATED_IN'")


_BALL = "b{x} AS (SELECT '{at}' AS id, 0 AS hop UNION SELECT other, hop + 1 FROM b{x} JOIN und ON anchor = id WHERE hop < {most})"
_REC = WITH.replace("WITH ent", "WITH RECURSIVE ent", 1)


@query("j4_shortest_path", f"{_REC}, {_BALL.format(x='', at='C1', most=4)} SELECT 'S1' AS target, coalesce((SELECT min(hop) FROM b WHERE id = 'S1'), -1) AS length UNION ALL SELECT 'nowhere', -1")
def j4(spark, d):
    e = relationships(spark, d)
    found = [(x, len(nw.shortest_path(e, "C1", x, 4)) - 1) for x in ("S1", "nowhere")]
    return spark.createDataFrame(found, "target string, length int")


@query("j10_common_surroundings", f"{_REC}, {_BALL.format(x='1', at='S1', most=2)}, {_BALL.format(x='2', at='S2', most=2)} SELECT id FROM b1 WHERE id NOT IN ('S1', 'S2') INTERSECT SELECT id FROM b2")
def j10(spark, d):
    return nw.common_surroundings(relationships(spark, d), "S1", "S2")


@query("a14_attribution", "WITH seen AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM seen) GROUP BY 1) SELECT l_suppkey AS \"group\", shared, round(shared / (SELECT count(*) FROM seen), 4) AS coverage FROM s ORDER BY shared DESC, l_suppkey LIMIT 10")
def a14(spark, d):
    uses = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_partkey").alias("technique"), "l_returnflag")
    return nw.attribution(uses, uses.filter("l_returnflag = 'R'"))


@query("j14_parent_collapse", "SELECT coalesce(p.p_brand, p.p_name) AS parent, count(DISTINCT l.l_suppkey) AS n FROM lineitem l JOIN part p ON l_partkey = p_partkey GROUP BY 1")
def j14(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.coalesce("p_brand", "p_name").alias("parent"))
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(parts, "l_partkey").groupBy("parent").agg(F.count_distinct("l_suppkey").alias("n"))


@query("j24_watchlist", f"{WITH} SELECT id, name, count(anchor) AS degree FROM ent LEFT JOIN und ON anchor = id WHERE entity_type = 'Organization' GROUP BY 1, 2")
def j24(spark, d):
    watched = entities(spark, d).filter("entity_type = 'Organization'").select("id", "name")
    return watched.join(g.degree(relationships(spark, d)).select("id", "degree"), "id", "left").fillna(0, ["degree"])


@query("w8_co_occurrence", "WITH l AS (SELECT l_orderkey AS o, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS p FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS n FROM l x JOIN l y ON x.o = y.o AND y.p - x.p BETWEEN 1 AND 2 AND x.s <> y.s GROUP BY 1, 2")
def w8(spark, d):
    lines = table(spark, d, "lineitem").withColumn("place", F.struct("l_linenumber", "l_suppkey"))  # line numbers repeat in an order
    return nw.co_occurrence(lines, "l_orderkey", "place", "l_suppkey")


@query("w10_survivors", "SELECT o_custkey, lower(o_orderpriority) AS label, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS kept FROM orders GROUP BY 1, 2")
def w10(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.lower("o_orderpriority").alias("label"), F.col("o_orderkey").alias("kept"), "o_orderdate")
    return nw.survivors(rows, [F.col("o_custkey"), F.col("label")], [F.col("o_orderdate"), F.col("kept")]).drop("o_orderdate")


_INTO = "into_ AS (SELECT 'S' || s_suppkey AS id, 'S' || (s_suppkey - 1) AS survivor FROM supplier WHERE s_suppkey % 2 = 0)"


@query("x4_merge", f"{WITH}, {_INTO} SELECT DISTINCT coalesce(survivor, source_id) AS source_id, target_id, rel_type FROM rel LEFT JOIN into_ ON id = source_id")
def x4(spark, d):
    into = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("S"), (F.col("s_suppkey") - 1).cast("string")).alias("survivor"))
    return nw.merge_entities(relationships(spark, d), into)


@query("k4_detach", f"{WITH}, gone AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_size > 10) SELECT * FROM rel WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def k4(spark, d):
    gone = table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    return nw.detach(relationships(spark, d), gone)


@query("k7_entity_rows", f"""{WITH} SELECT id, translate(name, ',"', ';''') AS name, entity_type FROM ent""")
def k7(spark, d):
    return entities(spark, d).select("id", tx.csv_name(F.col("name")).alias("name"), "entity_type")


@query("g7_density", f"{WITH}, n AS (SELECT count(*) AS n_nodes FROM ent), e AS (SELECT count(*) AS n_edges FROM (SELECT DISTINCT source_id, target_id FROM rel)) SELECT n_nodes, n_edges, n_edges / (n_nodes * (n_nodes - 1)) AS density FROM n, e")
def g7(spark, d):
    return nw.density(relationships(spark, d), entities(spark, d).select("id"))


_NATIONS = "f AS (SELECT target_id, min(source_id) AS m FROM rel WHERE rel_type = 'LOCATED_IN' GROUP BY 1), c AS (SELECT source_id AS id, least(m, target_id) AS comp FROM rel JOIN f USING (target_id) WHERE rel_type = 'LOCATED_IN' UNION SELECT target_id, least(m, target_id) FROM f)"


@query("g7_components", f"{WITH}, {_NATIONS} SELECT comp, count(*) AS n FROM c GROUP BY 1")
def g7_components(spark, d):
    e = located(spark, d)
    nodes = e.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return nw.components(e, nodes).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


@query("g7_components_graph")
def g7_components_graph(spark, d):
    return nw.components(relationships(spark, d), entities(spark, d).select("id")).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


@query("g12_collapse", f"{WITH}, m AS (SELECT source_id AS id, target_id AS comp FROM rel WHERE rel_type = 'LOCATED_IN' UNION SELECT id, id FROM ent WHERE entity_type = 'Product') SELECT least(x.comp, y.comp) AS a, greatest(x.comp, y.comp) AS b, count(*) AS weight FROM rel JOIN m x ON x.id = source_id JOIN m y ON y.id = target_id WHERE x.comp <> y.comp GROUP BY 1, 2")
def g12(spark, d):
    e, n = relationships(spark, d), entities(spark, d)
    products = n.filter("entity_type = 'Product'").select("id", F.col("id").alias("comp"))
    comp = located(spark, d).select(F.col("source_id").alias("id"), F.col("target_id").alias("comp")).union(products)
    return nw.collapse(e, comp.join(n.select("id", "name"), "id"))[1]


@query("d2_period_bounds", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', t) WHEN 1 THEN date_trunc('month', t) ELSE date_trunc('year', t) END::TIMESTAMP AS first, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', t) + INTERVAL 1 DAY WHEN 1 THEN date_trunc('month', t) + INTERVAL 1 MONTH ELSE date_trunc('year', t) + INTERVAL 1 YEAR END - INTERVAL 1 MICROSECOND AS last FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS t FROM orders)")
def d2(spark, d):
    kind = F.element_at(F.array(F.lit("day"), F.lit("month"), F.lit("year")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    first, last = tx.period_bounds(F.col("o_orderdate").cast("timestamp"), kind)
    return table(spark, d, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))


@query("d6_buckets", "SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders GROUP BY 1")
def d6(spark, d):
    return table(spark, d, "orders").groupBy(tx.bucket_key(F.col("o_orderdate").cast("timestamp"), "month").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("f22_occurrences", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n, strpos(text, 'the') - 1 AS first FROM documents WHERE contains(text, 'the')")
def f22(spark, d):
    found = table(spark, d, "documents").filter(F.contains("text", F.lit("the"))).select("doc_id", tx.occurrences(F.col("text"), "the").alias("at"))
    return found.select("doc_id", F.size("at").alias("n"), F.element_at("at", 1).alias("first"))


@query("f25_record_text", "SELECT n_nationkey, 'n_name: ' || n_name || '. n_regionkey: ' || n_regionkey || '.' AS record FROM nation")
def f25(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tx.record_text("n_name", "n_regionkey").alias("record"))


@query("f26_file_names", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_\-.]', '_', 'g') AS file FROM pages")
def f26(spark, d):
    return table(spark, d, "pages").select("page_id", tx.file_name(F.col("url")).alias("file"))


def _placed(spark, d):
    """Who is in which nation, and which nation in which region, all directed upwards; and all their ends."""
    named = lambda t, p, c, q, k: table(spark, d, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("source_id"), F.concat(F.lit(q), F.col(k).cast("string")).alias("target_id"))
    edges = named("customer", "C", "c_custkey", "N", "c_nationkey").unionByName(named("supplier", "S", "s_suppkey", "N", "s_nationkey")).unionByName(named("nation", "N", "n_nationkey", "R", "n_regionkey"))
    return edges, edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


_PLACES = """e AS (SELECT 'C' || c_custkey AS s, 'N' || c_nationkey AS t FROM customer UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
n AS (SELECT s AS id FROM e UNION SELECT t FROM e)"""


@query("g3_betweenness", f"WITH {_PLACES} SELECT n.id, round((SELECT count(*) FROM e WHERE t = n.id) * (SELECT count(*) FROM e WHERE s = n.id) / ((SELECT count(*) FROM n) - 1.0) / ((SELECT count(*) FROM n) - 2.0), 9) AS betweenness FROM n")
def g3(spark, d):
    return g.betweenness(*_placed(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query(
    "g6_closeness",
    f"""WITH {_PLACES}, p AS (SELECT s, t, 1 AS hop FROM e UNION ALL SELECT a.s, b.t, 2 FROM e a JOIN e b ON a.t = b.s), r AS (SELECT t AS id, count(*) AS k, sum(hop) AS far FROM p GROUP BY 1)
    SELECT n.id, round(coalesce(k / far * k / ((SELECT count(*) FROM n) - 1.0), 0), 9) AS closeness FROM n LEFT JOIN r ON r.id = n.id""",
)
def g6(spark, d):
    return g.closeness(*_placed(spark, d)).withColumn("closeness", F.round("closeness", 9))
