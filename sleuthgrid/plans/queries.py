"""A query for each operator, over the star-schema, event and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import collection as co
from ..operators import graph as g
from ..operators import profile as pf
from ..operators import retrieval as rt
from .catalog import query
from .model import ENTITIES, RELATIONSHIPS, assertions, entities, relationships, table

WITH = f"WITH ent AS ({ENTITIES}), rel AS ({RELATIONSHIPS}), und AS (SELECT source_id AS anchor, target_id AS other, rel_type FROM rel UNION ALL SELECT target_id, source_id, rel_type FROM rel WHERE source_id <> target_id)"


@query("p1_name_search", f"{WITH} SELECT id, name, entity_type FROM ent WHERE contains(lower(name), '1') AND contains(lower(name), 'er') ORDER BY name, id LIMIT 50 OFFSET 5")
def p1(spark, d):
    return entities(spark, d).filter(tx.matches_all(F.col("name"), "1 ER")).orderBy("name", "id").offset(5).limit(50)


@query("p2_count", f"{WITH} SELECT entity_type, count(*) AS n FROM ent WHERE contains(lower(name), '1') GROUP BY 1")
def p2(spark, d):
    return entities(spark, d).filter(tx.matches_all(F.col("name"), "1")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("p3_exact_name", f"{WITH} SELECT id, name, entity_type FROM ent WHERE lower(name) = lower((SELECT min(name) FROM ent WHERE entity_type = 'Organization')) AND entity_type = 'Organization' ORDER BY id LIMIT 1")
def p3(spark, d):
    e = entities(spark, d).filter("entity_type = 'Organization'")
    least = F.broadcast(e.agg(F.min("name").alias("least")))
    return e.join(least, F.lower("name") == F.lower("least")).drop("least").orderBy("id").limit(1)


@query("p7_area", "SELECT user_id, count(*) AS n FROM (SELECT user_id, (event_id % 180) - 90 AS lat, (event_id % 360) - 180 AS lng FROM events) WHERE lat BETWEEN -10 AND 40 AND lng BETWEEN 0 AND 90 GROUP BY 1")
def p7(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 180 - 90).alias("lat"), (F.col("event_id") % 360 - 180).alias("lng"))
    return e.filter(F.col("lat").between(-10, 40) & F.col("lng").between(0, 90)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("p8_heavy_fields", "SELECT doc_id, lang, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def p8(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", tx.shorten(F.col("text")).alias("preview"))


@query("p9_junk_names", "SELECT doc_id, i, NOT regexp_matches(line, '[\\p{L}\\p{N}]') AS junk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def p9(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), tx.junk_name(F.col("line")).alias("junk"))


_FURNITURE = "|".join(x.replace("©", "\\xA9") for x in tx.FURNITURE)
_LINES = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN replace(text, '. ', ' | ') WHEN 2 THEN concat('A line that says Read More about it', chr(10), text, chr(10), 'Home | Search | About | Contact') WHEN 3 THEN concat('one • two • three • four five', chr(10), chr(9), text) WHEN 4 THEN concat('one | two | three • four • five', chr(10), text) ELSE concat('1234567890 12345678 abc', chr(10), text) END AS text FROM documents"


@query(
    "p13_clean_lines",
    f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
    lambda l: length(l) >= 15 AND length(regexp_replace(l, '[^\\p{{L}}]', '', 'g')) >= 0.4 * length(l) AND length(regexp_replace(l, '[^|]', '', 'g')) <= 2 AND length(regexp_replace(l, '[^•]', '', 'g')) <= 2 AND NOT regexp_matches(lower(l), '{_FURNITURE}')), chr(10))) AS cleaned FROM ({_LINES})""",
)
def p13(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("lines_of_documents")
    lines = spark.sql(_LINES.replace("FROM documents", "FROM lines_of_documents"))
    return lines.select("doc_id", F.md5(tx.clean_lines(F.col("text"))).alias("cleaned"))


_URLS = "CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('http://', page_id % 256, '.168.', page_id % 7, '.1/x') WHEN 2 THEN concat('https://user@172.', page_id % 40, '.0.1:80/') WHEN 3 THEN concat('ftp://', url) WHEN 4 THEN 'http://Redis:6379/x' WHEN 5 THEN 'http://0x7f000001/' WHEN 6 THEN concat('http://198.', page_id % 60, '.3.4') ELSE 'https://[::1]/x' END"


@query(
    "p15_safe_urls",
    rf"""SELECT page_id, h <> '' AND h NOT IN ({", ".join(f"'{x}'" for x in tx.BLOCKED_HOSTS)}) AND NOT regexp_matches(h, '^0x|:') AND NOT (regexp_matches(h, '^[0-9.]+$') AND (
    o[1] IN (0, 10, 127) OR o[1] >= 240 AND o[1] <= 255 OR o[1] = 192 AND o[2] = 168 OR o[1] = 172 AND o[2] BETWEEN 16 AND 31 OR o[1] = 198 AND o[2] IN (18, 19, 51))) AS safe
    FROM (SELECT page_id, h, list_transform(string_split(h, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS o FROM (SELECT page_id, regexp_extract(lower({_URLS}), '^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1) AS h FROM pages))""",
)
def p15(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_url(F.expr(_URLS)).alias("safe"))


@query("p17_since", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def p17(spark, d):
    return table(spark, d, "events").filter("ts > TIMESTAMP_NTZ'2024-01-15 00:00:00'").select("event_id", "event_type")


@query("j1_neighbours", f"{WITH} SELECT anchor, other, rel_type, name, entity_type FROM und JOIN ent ON ent.id = other WHERE anchor IN ('S1', 'N3', 'P7')")
def j1(spark, d):
    return g.neighbours(relationships(spark, d), entities(spark, d), ["S1", "N3", "P7"]).select("anchor", "other", "rel_type", "name", "entity_type")


@query("j3_k_hop", f"{WITH}, h1 AS (SELECT DISTINCT other AS id FROM und WHERE anchor = 'S1'), h2 AS (SELECT DISTINCT other AS id FROM und JOIN h1 ON anchor = h1.id) SELECT id, min(hop) AS hop FROM (SELECT 'S1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1")
def j3(spark, d):
    return g.k_hop(relationships(spark, d), "S1", 2)


@query("j5_induced", f"{WITH}, keep AS (SELECT id FROM ent WHERE entity_type <> 'Person') SELECT * FROM rel WHERE source_id IN (SELECT id FROM keep) AND target_id IN (SELECT id FROM keep)")
def j5(spark, d):
    return g.induced(relationships(spark, d), entities(spark, d).filter("entity_type <> 'Person'"))


@query("j8_corroborating", "SELECT a.l_orderkey AS doc, count(DISTINCT b.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey GROUP BY 1")
def j8(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()  # noqa: E741
    a, b = l.alias("a"), l.alias("b")
    pairs = a.join(b, (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("a.l_suppkey") == F.col("b.l_suppkey")) & (F.col("a.l_orderkey") != F.col("b.l_orderkey")))
    return pairs.groupBy(F.col("a.l_orderkey").alias("doc")).agg(F.count_distinct("b.l_orderkey").alias("n"))


@query("j9_shared_links", "WITH e AS (SELECT DISTINCT o_custkey AS s, n_nationkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) SELECT a.t AS a, b.t AS b, count(*) AS connection_count, array_to_string(list_sort(list(a.s))[1:10], ',') AS shared FROM e a JOIN e b ON a.s = b.s AND a.t < b.t GROUP BY 1, 2")
def j9(spark, d):
    t = lambda n: table(spark, d, n)
    e = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    out = g.shared_entity_links(e.select(F.col("o_custkey").alias("source_id"), F.col("s_nationkey").alias("target_id")))
    return out.withColumn("shared", F.array_join(F.col("shared").cast("array<string>"), ","))


@query("j11_document_counts", "SELECT o_orderkey AS doc, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' GROUP BY 1")
def j11(spark, d):
    counts = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc")).join(counts, "doc", "left").fillna(0, ["n"])


@query("j15_overlap", "WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) SELECT l_suppkey, count(*) AS shared, round(count(*) / (SELECT count(*) FROM o), 4) AS coverage FROM s JOIN o USING (l_partkey) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def j15(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    seen = l.filter("l_returnflag = 'R' AND l_quantity >= 45").select("l_partkey").distinct()
    total = seen.agg(F.count(F.lit(1)).alias("total"))
    shared = l.select("l_suppkey", "l_partkey").distinct().join(seen, "l_partkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("shared"))
    return shared.crossJoin(F.broadcast(total)).select("l_suppkey", "shared", F.round(F.col("shared") / F.col("total"), 4).alias("coverage")).orderBy(F.desc("shared"), "l_suppkey").limit(10)


@query("j19_unmapped", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 40)")
def j19(spark, d):
    hit = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(hit, "p_partkey", "left_anti").select("p_partkey", "p_name")


_RANKS = "a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents)"


@query("j21_rank_fusion", f"WITH {_RANKS} SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.4 / (60 + a.r), 0) + coalesce(0.6 / (60 + b.r), 0), 9) AS score FROM (SELECT * FROM a WHERE r <= 100) a FULL JOIN (SELECT * FROM b WHERE r <= 100) b ON a.id = b.id")
def j21(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    top = lambda *o: docs.orderBy(*o).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*o)))
    return rt.fuse(top(F.desc("n_chars"), "id"), top("n_chars", "id")).withColumn("score", F.round("score", 9))


@query("a1_counts", f"{WITH} SELECT rel_type, count(*) AS n FROM rel GROUP BY 1")
def a1(spark, d):
    return relationships(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("a4_coverage", f"{WITH}, deg AS (SELECT anchor AS id, count(*) AS n FROM und GROUP BY 1) SELECT entity_type, count(*) AS total, count(*) FILTER (n IS NULL) AS isolated, count(*) FILTER (n = 1) AS single_link, array_to_string(list_sort(list(name) FILTER (n IS NULL))[1:10], '; ') AS isolated_names FROM ent LEFT JOIN deg USING (id) GROUP BY 1")
def a4(spark, d):
    deg = g.degree(relationships(spark, d)).select("id", F.col("degree").alias("n"))
    e = entities(spark, d).join(deg, "id", "left")
    alone = F.col("n").isNull()
    first = co.latest(e.filter(alone), ["entity_type"], [F.col("name"), F.col("id")], 10).groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("isolated_names"))
    out = e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(alone).alias("isolated"), F.count_if(F.col("n") == 1).alias("single_link"))
    return out.join(first, "entity_type", "left")


_CLAIMS = """r AS (SELECT l_suppkey AS s, l_partkey AS t, round(1 - l_discount * 5, 2) AS c, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS doc, CASE WHEN l_returnflag = 'R' THEN 'denies' ELSE 'asserts' END AS pol,
CASE WHEN l_linenumber % 2 = 1 THEN 'line ' || l_linenumber END AS said, l_shipdate AS seen, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"""
_FOLD = f"""WITH {_CLAIMS}, o AS (SELECT *, first_value(pol) OVER w AS pol1 FROM r WINDOW w AS (PARTITION BY s, t ORDER BY seen, id)),
p AS (SELECT *, bool_or(pol <> pol1) OVER (PARTITION BY s, t ORDER BY seen, id ROWS UNBOUNDED PRECEDING) AS dissent FROM o)
SELECT s AS source_id, t AS target_id, 'SUPPLIES' AS rel_type, CAST(greatest(1, count(DISTINCT doc)) AS INTEGER) AS corroboration_count,
CASE WHEN bool_or(dissent) THEN 'CONFLICT' ELSE 'AGREE' END AS agreement,
CASE WHEN bool_or(dissent) THEN least(max(c) FILTER (NOT dissent), min(c) FILTER (dissent)) ELSE max(c) END AS confidence, min(pol1) AS polarity,
arg_min(doc, (seen, id)) FILTER (doc IS NOT NULL) AS source_doc_id, arg_min(said, (seen, id)) FILTER (said IS NOT NULL) AS evidence, min(seen) AS first_seen, max(seen) AS last_seen FROM p GROUP BY s, t"""


@query("a6_corroboration", _FOLD)
def a6(spark, d):
    return g.corroborate(assertions(spark, d))


@query("a6_sources", f"WITH {_CLAIMS} SELECT s AS source_id, t AS target_id, 'SUPPLIES' AS rel_type, doc AS source_doc_id, min(seen) AS first_seen FROM r WHERE doc IS NOT NULL GROUP BY ALL")
def a6_sources(spark, d):
    return g.corroboration_sources(assertions(spark, d))


@query("g1_weighted", f"WITH {_CLAIMS} SELECT s AS source_id, t AS target_id, round(arg_max(c * CASE WHEN id % 2 = 0 THEN 1.5 ELSE 1 END, (seen, id)), 4) AS weight FROM r GROUP BY 1, 2")
def g1(spark, d):
    return g.weighted(assertions(spark, d).withColumn("rel_type", F.when(F.col("id") % 2 == 0, "TARGETS").otherwise("SUPPLIES")))


_CELLS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'x' WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('1,', o_orderkey % 900 + 100) END AS amount FROM orders"
_CELL_COLUMNS = ("o_orderkey", "status", "amount")


def _cells(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_of_cells")
    return spark.sql(_CELLS.replace("FROM orders", "FROM orders_of_cells"))


@query(
    "a7_profile",
    f"WITH c AS ({_CELLS}) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total, count(*) - count(v) AS null_count, round((count(*) - count(v)) / count(*), 4) AS null_rate, count(DISTINCT v) AS unique_count, CASE WHEN count(x) > count(v) / 2 THEN min(x) END AS min, CASE WHEN count(x) > count(v) / 2 THEN max(x) END AS max, CASE WHEN count(x) > count(v) / 2 THEN round(avg(x), 4) END AS mean
    FROM (SELECT nullif(trim(CAST({c} AS VARCHAR)), '') AS v, TRY_CAST(replace(CAST({c} AS VARCHAR), ',', '') AS DOUBLE) AS x FROM c)"""
        for c in _CELL_COLUMNS
    ),
)
def a7(spark, d):
    return pf.column_profile(_cells(spark, d))


@query(
    "a7_top_values",
    f"WITH c AS ({_CELLS}), l AS ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM c""" for c in _CELL_COLUMNS)
    + """), n AS (SELECT "column", value, count(*) AS n FROM l WHERE trim(value) <> '' GROUP BY 1, 2) SELECT * FROM (SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank, value, n FROM n) WHERE rank <= 10""",
)
def a7_top(spark, d):
    return pf.top_values(_cells(spark, d))


_TYPED = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE concat('1,', event_id % 900 + 100) END AS whole, concat('-', event_id % 10, '.5e3') AS real, concat('2024-01-', event_id % 20 + 10) AS day, CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'f' WHEN 2 THEN 'TRUE' ELSE 'n' END AS flag, concat(event_id % 2, '') AS bit, CASE WHEN event_id % 20 < 16 THEN concat('2024-02-', event_id % 19 + 10) ELSE 'soon' END AS mostly, event_type, CASE WHEN event_id < 0 THEN 'x' END AS nothing FROM events"
_TYPED_COLUMNS = ("whole", "real", "day", "flag", "bit", "mostly", "event_type", "nothing")


@query(
    "a8_inferred_type",
    f"WITH e AS ({_TYPED}) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(*) = 0 THEN 'null' WHEN bool_and(regexp_full_match(replace(v, ',', ''), '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(TRY_CAST(replace(v, ',', '') AS DOUBLE) IS NOT NULL) THEN 'float'
    WHEN count(*) FILTER (r <= 20 AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL) >= least(15, count(*)) THEN 'datetime' WHEN bool_and(lower(v) IN ('true', 'false', 'yes', 'no', '1', '0', 't', 'f', 'y', 'n')) THEN 'boolean' ELSE 'string' END AS inferred
    FROM (SELECT {c} AS v, row_number() OVER (ORDER BY event_id) AS r FROM e WHERE trim({c}) <> '' ORDER BY event_id LIMIT 100)"""
        for c in _TYPED_COLUMNS
    ),
)
def a8(spark, d):
    from functools import reduce

    table(spark, d, "events").createOrReplaceTempView("events_of_types")
    e = spark.sql(_TYPED.replace("FROM events", "FROM events_of_types"))
    return reduce(lambda a, b: a.unionByName(b), [pf.infer_type(e, c, "event_id") for c in _TYPED_COLUMNS])


@query("a9_histogram", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type AS kind, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def a9(spark, d):
    return pf.histogram(table(spark, d, "events"), "ts", "event_type")


_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query("a17_run_state", "WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e, max(ts) AS seen FROM events GROUP BY 1) SELECT user_id, CASE WHEN e IN ('purchase') THEN e WHEN m.now - seen > INTERVAL 600 SECOND THEN 'stalled' ELSE 'running' END AS state, e AS last_event FROM l, m")
def a17(spark, d):
    e = table(spark, d, "events")
    return pf.run_state(e, "user_id", "ts", "event_type", "event_id", e.agg(F.max("ts").alias("now")), final=("purchase",))


@query("a18_current_run", "WITH n AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events) SELECT event_id, user_id, CAST(run AS BIGINT) AS run FROM n QUALIFY run = max(run) OVER (PARTITION BY user_id)")
def a18(spark, d):
    return pf.current_run(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ("purchase",)).select("event_id", "user_id", "run")


@query("a24_degree", f"{WITH} SELECT id, count(*) AS degree, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM rel UNION ALL SELECT target_id, 1, 0 FROM rel) GROUP BY 1")
def a24(spark, d):
    return g.degree(relationships(spark, d))


@query("a25_keyword_counts", "SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n FROM documents")
def a25(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.keyword_count(F.col("text"), "The").alias("n"))


@query("w3_first_occurrence", "SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2")
def w3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))


@query("w4_packing", "SELECT lang, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT lang, doc_id, sum(n_chars + 2) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 100000")
def w4(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return rt.pack(docs, "lang", [F.desc("n_chars"), F.col("doc_id")], F.col("n_chars") + 2, 100_000).select("lang", "doc_id", "used")


@query("l2_most_connected", f"{WITH}, deg AS (SELECT anchor AS id, count(*) AS degree FROM und GROUP BY 1) SELECT id, name, entity_type, coalesce(degree, 0) AS degree FROM ent LEFT JOIN deg USING (id) ORDER BY 4 DESC, 1 LIMIT 50")
def l2(spark, d):
    return g.most_connected(entities(spark, d), relationships(spark, d), 50)


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query("l3_vector_top_k", f"SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]) DESC, vec_id LIMIT 20) WHERE similarity >= 0.15")
def l3(spark, d):
    base = table(spark, d, "embeddings")
    q = base.filter("vec_id = 0").head()["embedding"]
    return rt.vector_top_k(base, list(q), 20, 0.15).withColumn("similarity", F.round("similarity", 6))


@query("u1_intersection", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 2 = 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey % 2 = 1")
def u1(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.filter("l_suppkey % 2 = 0").select("l_partkey").intersect(l.filter("l_suppkey % 2 = 1").select("l_partkey"))


@query("u3_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def u3(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct())


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_OBSERVED = f"""CASE page_id % 12 WHEN 0 THEN replace(replace(url, 'http', 'hxxp'), '.', '[.]') WHEN 1 THEN replace({_HOST}, '.', '(dot)') WHEN 2 THEN concat(' User.', page_id, '[AT]', replace({_HOST}, '.', '[ . ]'))
 WHEN 3 THEN concat('10.0.', page_id % 300, '.', page_id % 256) WHEN 4 THEN concat('cve-2024-', 10000 + page_id) WHEN 5 THEN md5(url) WHEN 6 THEN concat('hXXps(:)//', replace({_HOST}, '.', '{{.}}'), '/x')
 WHEN 7 THEN concat('a b c ', page_id) WHEN 8 THEN concat({_HOST}, '.') WHEN 9 THEN concat('a{{at}}', {_HOST}) WHEN 10 THEN concat('x', page_id, '[@]b(.)org') ELSE url END"""
_REFANGED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)hxxp', 'http', 'g'), '(?i)[\\[({{]\\s*(\\.|dot)\\s*[\\])}}]', '.', 'g'), '(?i)[\\[({{]\\s*(@|at)\\s*[\\])}}]', '@', 'g'), '[\\[({{]\\s*:\\s*[\\])}}]', ':', 'g')"


@query("f1_refang", f"SELECT page_id, {_REFANGED.format('v')} AS refanged FROM (SELECT page_id, {_OBSERVED} AS v FROM pages)")
def f1(spark, d):
    return table(spark, d, "pages").select("page_id", tx.refang(F.expr(_OBSERVED)).alias("refanged"))


_SHOUTED = "CASE WHEN page_id % 3 = 0 THEN upper(url) ELSE concat(url, '@x') END"


@query("f2_defang", f"SELECT page_id, replace(replace(replace({_SHOUTED}, 'http', 'hxxp'), '.', '[.]'), '@', '[at]') AS defanged, {_SHOUTED} AS refanged FROM pages")
def f2(spark, d):
    safe = tx.defang(F.expr(_SHOUTED))
    return table(spark, d, "pages").select("page_id", safe.alias("defanged"), tx.refang(safe).alias("refanged"))


@query(
    "f3_observables",
    rf"""WITH w AS (SELECT page_id, trim({_REFANGED.format('v')}) AS v FROM (SELECT page_id, {_OBSERVED} AS v FROM pages) UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\d{{1,3}}(?:\.\d{{1,3}}){{3}}')) FROM documents)
    SELECT page_id, v, CASE WHEN regexp_matches(v, '^(?i)https?://') THEN 'URL' WHEN regexp_matches(v, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$') THEN 'EmailAddress'
    WHEN regexp_matches(v, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN CASE WHEN list_max(list_transform(string_split(v, '.'), lambda x: x::INTEGER)) <= 255 THEN 'IPAddress' ELSE '' END
    WHEN regexp_matches(v, '^(?i)cve-[0-9]{{4}}-[0-9]{{4,}}$') THEN 'Vulnerability' WHEN regexp_matches(v, '^[A-Fa-f0-9]+$') AND length(v) IN (32, 40, 64) THEN 'Hash'
    WHEN regexp_matches(v, '^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}$') THEN 'Domain' ELSE '' END AS kind FROM w""",
)
def f3(spark, d):
    found = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.explode(F.regexp_extract_all("text", F.lit(r"(\d{1,3}(?:\.\d{1,3}){3})"), 1)).alias("v"))
    every = table(spark, d, "pages").select("page_id", F.expr(_OBSERVED).alias("v")).unionByName(found)
    return every.select("page_id", tx.strip_space(tx.refang(F.col("v"))).alias("v"), tx.classify_observable(F.col("v")).alias("kind"))


@query("f7_hosts", r"SELECT regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/?#:]*)', 1), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def f7(spark, d):
    return table(spark, d, "pages").groupBy(tx.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_tokens", rf"SELECT t AS token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}'))) AS t FROM documents) WHERE t NOT IN ({', '.join(repr(x) for x in tx.STOP_WORDS)}) GROUP BY 1")
def f11(spark, d):
    t = table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_P = "l_discount * 12.5 - 0.1"


@query("d13_probability", f"""SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.01 OR p > 0.99 THEN 'Unknown' {" ".join(f"WHEN p < {high} THEN '{label}'" for _, high, label in tx.PROBABILITY[:-1])} ELSE 'Almost Certain' END AS label FROM (SELECT *, {_P} AS p FROM lineitem)""")
def d13(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.probability_label(F.expr(_P)).alias("label"))


_CELL = "CASE doc_id % 7 WHEN 0 THEN concat('=', lang) WHEN 1 THEN concat(chr(9), '=1') WHEN 2 THEN concat(chr(10), ' +', lang) WHEN 3 THEN concat(' |', lang) WHEN 4 THEN concat(chr(92), lang) WHEN 5 THEN concat('a=', lang) ELSE lang END"


@query("k18_guarded_cells", rf"SELECT doc_id, CASE WHEN regexp_matches(c, '^\s*[=+\-@|\\]') THEN chr(39) || c ELSE c END AS cell FROM (SELECT doc_id, {_CELL} AS c FROM documents)")
def k18(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.guard_cell(F.expr(_CELL)).alias("cell"))


@query(
    "m1_tf_idf",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{2,}')) AS ts FROM documents), n AS (SELECT count(*) AS n, greatest(2, CAST(floor(0.85 * count(*)) AS BIGINT)) AS top FROM t),
    f AS (SELECT doc_id, len(ts) AS size, unnest(ts) AS term FROM t), c AS (SELECT doc_id, size, term, count(*) AS k FROM f GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
    s AS (SELECT bool_and(ok) AS covered, min(rarest) AS rarest FROM (SELECT doc_id, bool_or(df BETWEEN 2 AND top) AS ok, min(df) AS rarest FROM c JOIN df USING (term), n GROUP BY 1)),
    w AS (SELECT doc_id, term, k / size * ln(n / df) AS w FROM c JOIN df USING (term), n, s WHERE df BETWEEN 2 AND top OR NOT covered AND (df <= top OR rarest > top))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""".replace("'[a-z]{2,}')", f"'[a-z]{{2,}}') AND x NOT IN ({', '.join(repr(x) for x in tx.STOP_WORDS)})"),
)
def m1(spark, d):
    return rt.tf_idf(table(spark, d, "documents"), tx.tokens(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query("g4_page_rank")
def g4(spark, d):
    edges = relationships(spark, d).withColumn("confidence", F.when(F.col("rel_type") == "SUPPLIES", 0.8)).withColumn("seen", F.lit(0)).withColumn("id", F.col("rel_type"))
    return g.page_rank(g.weighted(edges), entities(spark, d))


_LOCATED = "SELECT 'C' || c_custkey AS s, 'N' || c_nationkey AS t, 1.0 + c_custkey % 3 AS w FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 2.0 FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 1.5 FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'C' || s_suppkey, 0.5 FROM supplier"


@query(
    "g9_structural_holes",
    f"""WITH e AS ({_LOCATED}), b AS (SELECT u, v, sum(w) AS w FROM (SELECT s AS u, t AS v, w FROM e UNION ALL SELECT t, s, w FROM e) GROUP BY 1, 2),
    q AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS p, count(*) OVER (PARTITION BY u) AS n FROM b),
    h AS (SELECT a.u, c.v, sum(a.p * c.p) AS way, count(*) AS common FROM q a JOIN q c ON a.v = c.u GROUP BY 1, 2), l AS (SELECT q.u, q.v, q.n, q.p, h.way, coalesce(h.common, 0) AS common FROM q LEFT JOIN h ON h.u = q.u AND h.v = q.v)
    SELECT u AS id, round(sum((p + coalesce(way, 0)) ** 2), 9) AS "constraint", round(max(n) - sum(common) / max(n), 9) AS effective_size, sum((p + coalesce(way, 0)) ** 2) < 0.5 AND max(n) - sum(common) / max(n) > 1.5 AND max(n) >= 3 AS is_broker FROM l GROUP BY 1""",
)
def g9(spark, d):
    t = lambda n, a, x, b, y, w: table(spark, d, n).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target_id"), w.cast("double").alias("weight"))
    edges = t("customer", "C", "c_custkey", "N", "c_nationkey", 1 + F.col("c_custkey") % 3).union(t("nation", "N", "n_nationkey", "R", "n_regionkey", F.lit(2)))
    edges = edges.union(t("supplier", "S", "s_suppkey", "N", "s_nationkey", F.lit(1.5))).union(t("supplier", "S", "s_suppkey", "C", "s_suppkey", F.lit(0.5)))
    return g.structural_holes(edges).withColumn("constraint", F.round("constraint", 9)).withColumn("effective_size", F.round("effective_size", 9))


_ONCE = WITH.replace("rel AS (", "rel AS MATERIALIZED (").replace("und AS (", "und AS MATERIALIZED (")


@query("g10_ego", f"{_ONCE}, h1 AS MATERIALIZED (SELECT other AS id FROM und WHERE anchor = 'N3' UNION SELECT 'N3'), h2 AS MATERIALIZED (SELECT other AS id FROM und JOIN h1 ON anchor = h1.id UNION SELECT id FROM h1) SELECT rel.* FROM rel JOIN h2 s ON source_id = s.id JOIN h2 t ON target_id = t.id")
def g10(spark, d):
    return g.ego(relationships(spark, d), "N3", 2)[1]


@query("t1_rate_limit")
def t1(spark, d):
    return pf.rate_exceeded(table(spark, d, "events"), "user_id", "ts", "event_id", 36_000, 3).select("event_id", "recent", "rejected")
