"""Queries of retrieval for questions, and of budgets shared by elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as ca
from ..operators import hybrid as hy
from ..operators.steps import cut
from .catalog import query
from .model import ENTITIES, entities, relationships, table
from .queries import WITH

_LABEL = "'[element ' || element || ' | doc ' || {} || ' | similarity ' || '0.0000' || '] '"
_HITS = """hits AS (SELECT doc_id % 37 AS requirement, doc_id // 37 % 40 + 1 AS element, doc_id AS document_id,
    row_number() OVER (PARTITION BY doc_id % 37, doc_id // 37 % 40 ORDER BY n_chars DESC, doc_id) AS rank, text FROM documents)"""


@query(
    "w6_fair_share",
    f"""WITH {_HITS}, t AS (SELECT requirement, element, rank, document_id, trim(array_to_string(list_transform(string_split(trim(coalesce(text, ''), ' '), chr(10)),
    lambda x: CASE WHEN regexp_matches(x, '(?i)(ignore|disregard|forget)\\s+(all\\s+)?(the\\s+)?(prior|previous|above|earlier)|new\\s+instructions?\\s*:|system\\s*(prompt|message)\\s*:|you\\s+are\\s+now\\b|EEI_ASSESSMENT|\\b(SATISFIED|PARTIAL|UNMET)\\s*\\|')
      THEN '[redacted: instruction-shaped text in source document]' ELSE x END), chr(10)), ' ') AS text,
    18000 // (SELECT count(DISTINCT element) FROM hits h WHERE h.requirement = hits.requirement AND element <= 32) AS share,
    length({_LABEL.format("repeat('x', 36)")}) + 2 AS over, length({_LABEL.format("document_id")}) + 2 AS label
  FROM hits WHERE element <= 32),
f AS (SELECT *, least(length(text), 1200) AS size FROM t WHERE text <> ''),
a AS (SELECT *, share - over - coalesce(sum(size + label) OVER (PARTITION BY requirement, element ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f),
b AS (SELECT *, CASE WHEN room >= 240 THEN least(size, room) END AS one FROM a),
c AS (SELECT *, coalesce(sum(one + label) OVER (PARTITION BY requirement), 0) AS spent,
    count(one) OVER (PARTITION BY requirement, element) = 0 AND row_number() OVER (PARTITION BY requirement, element ORDER BY rank) = 1 AS starved FROM b),
d AS (SELECT *, starved AND 18000 - spent - over - coalesce(sum(CASE WHEN starved THEN least(size, 240) + label ELSE 0 END)
    OVER (PARTITION BY requirement ORDER BY element, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 240 AS two FROM c),
e AS (SELECT *, CASE WHEN two THEN least(size, 240) ELSE one END AS chars FROM d),
g AS (SELECT *, coalesce(sum(chars + label) OVER (PARTITION BY requirement), 0) AS paid FROM e),
h AS (SELECT *, 18000 - paid - over - coalesce(sum(size + label) OVER (PARTITION BY requirement ORDER BY element, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room3 FROM g WHERE chars IS NULL),
o AS (SELECT requirement, element, rank, document_id, CASE WHEN two THEN 2 ELSE 1 END AS turn, text, chars, label FROM g WHERE chars IS NOT NULL
  UNION ALL SELECT requirement, element, rank, document_id, 3, text, least(size, room3), label FROM h WHERE room3 >= 240)
SELECT requirement, element, rank, document_id, turn, substr(text, 1, CAST(chars AS BIGINT)) AS snippet, CAST(chars + label AS BIGINT) AS cost FROM o""",
)
def w6(spark, d):
    """Documents as hits of the elements of 37 requirements, the longest first."""
    from pyspark.sql import Window

    doc = F.col("doc_id")
    rows = table(spark, d, "documents").withColumn("requirement", doc % 37).withColumn("element", F.floor(doc / 37) % 40 + 1)
    rank = F.row_number().over(Window.partitionBy("requirement", "element").orderBy(F.desc("n_chars"), "doc_id"))
    return hy.fair_share(rows.select("requirement", "element", rank.alias("rank"), doc.alias("document_id"), F.lit(0.0).alias("similarity"), "text"))


def _questions(spark, d):
    part = table(spark, d, "part").filter("p_partkey % 100 = 0")
    return part.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("question"), F.concat(F.lit("Who supplies "), F.col("p_name"), F.lit(" or Supplier#00000000"), (F.col("p_partkey") / 100 % 10).cast("int").cast("string"), F.lit("?")).alias("text"), (F.col("p_partkey") % 50).alias("vec_id"))


def _sourced(spark, d):
    number = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    return entities(spark, d).withColumn("source_doc_id", F.when(number % 3 != 0, number % 50))


_ABOUT = f"""ent AS ({ENTITIES}), q AS (SELECT 'Q' || p_partkey AS question, 'Who supplies ' || p_name || ' or Supplier#00000000' || CAST(p_partkey // 100 % 10 AS VARCHAR) || '?' AS text FROM part WHERE p_partkey % 100 = 0),
w AS (SELECT question, text, string_split(text, ' ') AS w FROM q),
s AS (SELECT question, 0 AS stage, 0 AS pos, lower(text) AS s FROM w
  UNION ALL SELECT question, 1, i, lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) FROM w, range(1, 20) r(i) WHERE i <= len(w) - 2
  UNION ALL SELECT question, 2, i, lower(w[i] || ' ' || w[i + 1]) FROM w, range(1, 20) r(i) WHERE i <= len(w) - 1
  UNION ALL SELECT question, 3, i, lower(trim(w[i], '?.,!;:''\"')) FROM w, range(1, 20) r(i) WHERE i <= len(w) AND length(trim(w[i], '?.,!;:''\"')) >= 3 AND lower(trim(w[i], '?.,!;:''\"')) NOT IN ('who', 'and', 'for', 'the')),
m AS (SELECT question, stage, pos, id, row_number() OVER (PARTITION BY question, stage, pos ORDER BY name, id) AS r FROM s JOIN ent
  ON len(list_filter(string_split(s, ' '), lambda t: NOT contains(lower(name), t))) = 0 WHERE stage IN (0, 3) OR length(s) >= 4),
k AS (SELECT question, id, min((stage, pos, r)) AS o FROM m WHERE r <= CASE WHEN stage = 0 THEN 10 ELSE 5 END GROUP BY ALL),
n AS (SELECT *, count(*) FILTER (o[1] = 0) OVER (PARTITION BY question) AS n0, count(*) FILTER (o[1] < 3) OVER (PARTITION BY question) AS n2 FROM k),
about AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY o) AS place FROM n WHERE o[1] = 0 OR n0 < 10 AND (o[1] < 3 OR n2 < 10)
  QUALIFY place <= 15)"""


@query("r1_understood", f"WITH {_ABOUT} SELECT question, id, CAST(place AS INTEGER) AS place FROM about")
def r1(spark, d):
    return hy.understand(entities(spark, d), _questions(spark, d))


@query(
    "r5_hybrid_ranking",
    f"""{WITH.replace("WITH ent AS (" + ENTITIES + "),", "WITH " + _ABOUT + ",")},
nb AS (SELECT DISTINCT anchor, other FROM und WHERE anchor <> other),
b1 AS (SELECT question, other AS id, place, 1 AS hop FROM about JOIN nb ON anchor = id),
b2 AS (SELECT DISTINCT question, other AS id, place, 2 AS hop FROM (SELECT DISTINCT question, id, place FROM b1) JOIN nb ON anchor = id),
ball AS (SELECT question, id, min((place, hop)) AS o FROM (SELECT question, id, place, 0 AS hop FROM about UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY ALL),
doc AS (SELECT question, x % 50 AS document_id, min((o[1], o[2], name, id)) AS o FROM (SELECT *, CAST(regexp_extract(id, '[0-9]+') AS BIGINT) AS x FROM ball JOIN ent USING (id)) WHERE x % 3 <> 0 GROUP BY ALL),
gr AS (SELECT question, document_id, row_number() OVER (PARTITION BY question ORDER BY o) AS graph_rank FROM doc),
qv AS (SELECT 'Q' || p_partkey AS question, embedding AS v FROM part JOIN embeddings ON vec_id = p_partkey % 50 WHERE p_partkey % 100 = 0),
sim AS (SELECT question, vec_id AS document_id, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 9) AS similarity FROM qv, embeddings),
vr AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, document_id) AS vector_rank FROM sim QUALIFY vector_rank <= 20),
f AS (SELECT coalesce(g.question, v.question) AS question, coalesce(g.document_id, v.document_id) AS document_id, graph_rank, vector_rank,
    round(coalesce(0.4 / (60 + graph_rank), 0) + coalesce(0.6 / (60 + vector_rank), 0), 9) AS score
  FROM gr g FULL JOIN (SELECT * FROM vr WHERE similarity >= 0.3) v ON g.question = v.question AND g.document_id = v.document_id)
SELECT question, document_id, score, CAST(graph_rank AS INTEGER) AS graph_rank, CAST(vector_rank AS INTEGER) AS vector_rank,
  CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM f""",
)
def r5(spark, d):
    asked = _questions(spark, d)
    ents = _sourced(spark, d)
    found = hy.nearest_documents(relationships(spark, d), hy.understand(ents, asked), ents)
    return hy.merged_ranking(found, _near(spark, d, asked))


def _near(spark, d, asked):
    vectors = table(spark, d, "embeddings")
    return hy.nearest_vectors(vectors, asked.join(vectors, "vec_id").select("question", "embedding"), 20, 0.3).withColumnRenamed("vec_id", "document_id")


@query("r3_context")
def r3(spark, d):
    """The contexts of the questions. tests/test_hybrid.py holds the text against one made by hand."""
    every, ents, rel = _questions(spark, d), _sourced(spark, d), relationships(spark, d)
    # questions of the same words and vector have one context
    asked = cut(every.groupBy("text", "vec_id").agg(F.min("question").alias("question")))
    about = hy.understand(ents, asked)
    found, around = hy.shared_surroundings(rel, about, 1)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    near = _near(spark, d, asked).join(docs, "document_id")
    made = cut(hy.context(found, ents, rel, hy.graph_documents(found, ents), docs, near, about=about, around=around))
    same = every.join(asked.withColumnRenamed("question", "as"), ["text", "vec_id"]).select("question", "as")
    return same.join(made.withColumnRenamed("question", "as"), "as").select("question", "context")


@query("g11_influence")
def g11(spark, d):
    """From the ten suppliers of smallest key, over who supplies what and who is where."""
    rel = relationships(spark, d).withColumn("weight", F.when(F.col("rel_type") == "SUPPLIES", 0.5).otherwise(1.5))
    seeds = table(spark, d, "supplier").filter("s_suppkey < 10").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
    return ca.influence(rel, seeds)
