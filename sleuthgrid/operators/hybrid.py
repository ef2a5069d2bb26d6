"""Retrieval for questions from the graph and from vectors together, and shares of a budget of characters among them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .graph import undirected
from .steps import cut

#: Words that name nothing in a question (fixed values).
ASKING = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "what", "with", "about", "this", "that", "from", "have", "how", "who", "which", "their", "been", "know", "tell", "show", "find", "does")
#: Characters of all passages, of one, and of the least that is worth showing; elements of a requirement.
BUDGET, PASSAGE, LEAST, ELEMENTS = 18_000, 1_200, 240, 32
INJECTION = r"(?i)(?:ignore|disregard|forget)\s+(?:all\s+)?(?:the\s+)?(?:prior|previous|above|earlier)|new\s+instructions?\s*:|system\s*(?:prompt|message)\s*:|you\s+are\s+now\b|EEI_ASSESSMENT|\b(?:SATISFIED|PARTIAL|UNMET)\s*\|"
REDACTED = "[redacted: instruction-shaped text in source document]"


def redact(text: Column) -> Column:
    """Lines that read like instructions to a model are replaced; a null text is empty."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(INJECTION), F.lit(REDACTED)).otherwise(x)), "\n")


def _label(element: Column, doc: Column, similarity: Column) -> Column:
    return F.concat(F.lit("[element "), element.cast("string"), F.lit(" | doc "), F.substring(F.coalesce(doc.cast("string"), F.lit("?")), 1, 36), F.lit(" | similarity "), F.format_string("%.4f", similarity), F.lit("] "))


def fair_share(hits: DataFrame, budget: int = BUDGET, passage: int = PASSAGE, least: int = LEAST) -> DataFrame:
    """requirement, element, rank, document_id, turn, snippet, cost of the hits that a requirement's budget of characters pays for.

    hits: requirement, element (from 1), rank, document_id, similarity, text.
    Texts are redacted and trimmed; those of which nothing is left cost nothing
    and are passed over. Elements over ELEMENTS have no share. Every element
    with hits gets an equal share; a passage is clipped to what is left of it,
    and isn't taken if that is under least (turn 1). Then elements that got
    nothing are each offered one passage of least characters, in order, while
    the budget lasts (turn 2), and what is left goes to further passages in
    order (turn 3). As an element's label only grows with its number, whoever
    is refused in turns 2 and 3 ends the turn, so all three are running sums.
    """
    rows = hits.filter(F.col("element") <= ELEMENTS).withColumn("text", F.trim(redact(F.trim("text"))))
    shares = rows.groupBy("requirement").agg(F.count_distinct("element").alias("of"))
    over = F.length(F.concat(F.lit("[element "), F.col("element").cast("string"), F.lit(" | doc "), F.lit("x" * 36), F.lit(" | similarity 0.0000] "))) + 2
    label = F.length(_label(F.col("element"), F.col("document_id"), F.col("similarity"))) + 2
    rows = rows.filter("text <> ''").join(shares, "requirement").withColumn("share", F.floor(F.lit(budget) / F.col("of"))).withColumn("over", over).withColumn("label", label).withColumn("full", F.least(F.length("text"), F.lit(passage)))
    order = ["element", "rank", "document_id"]
    past = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("full") + F.col("label")

    def pay(df: DataFrame, purse: Column, *by: str) -> DataFrame:
        """What a purse pays for in order: room is what the one before has left."""
        left = df.withColumn("room", purse - F.coalesce(F.sum(whole).over(past(*by)), F.lit(0)) - F.col("over"))
        return left.withColumn("chars", F.when(F.col("room") >= least, F.least("full", "room")))

    first = pay(rows, F.col("share"), "requirement", "element").withColumn("turn", F.when(F.col("chars").isNotNull(), 1))
    spent = F.sum(F.when(F.col("turn").isNotNull(), F.col("chars") + F.col("label")).otherwise(0)).over(Window.partitionBy("requirement"))
    got = F.max(F.coalesce("turn", F.lit(0))).over(Window.partitionBy("requirement", "element"))
    place = F.row_number().over(Window.partitionBy("requirement", "element").orderBy(*order))
    first = first.withColumn("spent", spent).withColumn("starved", (got == 0) & (place == 1))
    little = F.least("full", F.lit(least))
    offered = F.when(F.col("starved"), little + F.col("label")).otherwise(0)
    room2 = F.lit(budget) - F.col("spent") - F.coalesce(F.sum(offered).over(past("requirement")), F.lit(0)) - F.col("over")
    second = first.withColumn("room", room2).withColumn("two", F.col("starved") & (F.col("room") >= least))
    second = second.withColumn("chars", F.when(F.col("two"), little).otherwise(F.col("chars"))).withColumn("turn", F.when(F.col("two"), 2).otherwise(F.col("turn")))
    second = second.withColumn("spent", F.sum(F.when(F.col("turn").isNotNull(), F.col("chars") + F.col("label")).otherwise(0)).over(Window.partitionBy("requirement")))
    taken = second.filter("turn is not null")
    third = pay(second.filter("turn is null").drop("room"), F.lit(budget) - F.col("spent"), "requirement").filter("chars is not null").withColumn("turn", F.lit(3))
    out = ["requirement", "element", "rank", "document_id", "turn", "text", "chars", "label"]
    return taken.select(*out).unionByName(third.select(*out)).select("requirement", "element", "rank", "document_id", "turn", F.expr("substring(text, 1, chars)").alias("snippet"), (F.col("chars") + F.col("label")).cast("long").alias("cost"))


def understand(entities: DataFrame, questions: DataFrame) -> DataFrame:
    """question, id, place (from 1): at most 15 entities that each of questions (question, text) is about.

    The whole question is searched first (10 names), then its runs of three and
    of two words if that gave under 10, then its words that aren't in ASKING if
    there still are under 10 (5 names each); a name must hold every word of
    what is searched, without case, and names come in order. A question that
    finds nothing is about the first names. Each different search is done once,
    over different names, and only names with the rarest three characters of
    its words (a shorter word is looked for whole) are compared with it.
    """
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.struct(F.lit(4 - n).alias("stage"), i.alias("at"), F.when(F.size("w") >= n, F.array_join(F.slice("w", i + 1, n), " ")).alias("s")))
    clean = lambda w: F.lower(F.regexp_replace(w, r"^[?.,!;:'\"]+|[?.,!;:'\"]+$", ""))
    single = F.transform("w", lambda w, i: F.struct(F.lit(3).alias("stage"), i.alias("at"), F.when((F.length(clean(w)) >= 3) & ~clean(w).isin(*ASKING), clean(w)).alias("s")))
    whole = F.array(F.struct(F.lit(0).alias("stage"), F.lit(0).alias("at"), F.col("text").alias("s")))
    asked = questions.withColumn("w", words).select("question", F.explode(F.concat(whole, runs(3), runs(2), single)).alias("x")).select("question", "x.*").filter("s is not null").filter((F.col("stage").isin(0, 3)) | (F.length("s") >= 4))
    terms = F.slice(F.filter(F.split(F.lower(F.trim("s")), r"\s+"), lambda t: t != ""), 1, 12)
    asked = cut(asked.withColumn("terms", terms).filter(F.size("terms") > 0).select("question", "stage", "at", F.array_sort(F.array_distinct("terms")).alias("terms")))
    # a name is searched for what a search needs, and its first 10 ids are enough for any
    grams = lambda t: F.when(F.length(t) > 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array(t))
    wanted = cut(asked.select("terms").distinct().select("terms", F.explode(F.array_distinct(F.flatten(F.transform("terms", grams)))).alias("gram")))
    low = F.lower("name")
    at = lambda k: F.when(F.length(low) >= k, F.transform(F.sequence(F.lit(1), F.length(low) - (k - 1)), lambda i: F.substring(low, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    named = entities.filter("name is not null").select("id", "name")
    names = named.select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(at(1), at(2), at(3)))).alias("gram"))
    names = cut(names.join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi"))
    rare = wanted.join(names.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left").groupBy("terms").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).filter("m.n > 0")
    match = rare.select("terms", "m.gram").join(names, "gram").filter(F.forall("terms", lambda t: F.contains(F.lower("name"), t))).select("terms", "name")
    match = cut(match.withColumn("r", F.row_number().over(Window.partitionBy("terms").orderBy("name"))).filter("r <= 10").drop("r"))
    held = named.join(match.select("name").distinct(), "name", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter("r <= 10").drop("r")
    first = match.join(held, "name").withColumn("r", F.row_number().over(Window.partitionBy("terms").orderBy("name", "id"))).filter("r <= 10")
    found = asked.join(first, "terms").filter(F.col("r") <= F.when(F.col("stage") == 0, 10).otherwise(5))
    first = found.groupBy("question", "id").agg(F.min(F.struct("stage", "at", "r")).alias("o"))
    by = Window.partitionBy("question")
    first = first.withColumn("n0", F.sum((F.col("o.stage") == 0).cast("int")).over(by)).withColumn("n2", F.sum((F.col("o.stage") < 3).cast("int")).over(by))
    first = first.filter((F.col("o.stage") == 0) | (F.col("n0") < 10) & ((F.col("o.stage") < 3) | (F.col("n2") < 10)))
    found = cut(first.select("question", "id", F.row_number().over(by.orderBy("o")).alias("place")).filter("place <= 15"))
    missed = questions.select("question").join(found.select("question").distinct(), "question", "left_anti")
    usual = entities.orderBy("name", "id").limit(15).withColumn("place", F.row_number().over(Window.orderBy("name", "id"))).select("id", "place")
    return found.unionByName(missed.join(F.broadcast(usual), F.lit(True)).select("question", "id", "place"))


def surroundings(edges: DataFrame, about: DataFrame, hops: int = 2) -> DataFrame:
    """question, id, place, hop: every node within hops of what each question is about, with the first of these that reaches it and how far it is then."""
    both = cut(undirected(edges).select("anchor", "other").filter("anchor <> other").distinct())
    near = cut(about.select("question", "id", "place", F.lit(0).alias("hop")))
    seen = near
    for i in range(1, hops + 1):
        step = near.join(both, near["id"] == both["anchor"]).select("question", F.col("other").alias("id"), "place").groupBy("question", "id").agg(F.min("place").alias("place")).withColumn("hop", F.lit(i))
        near = cut(step.join(seen.select("question", "id", F.col("place").alias("had")), ["question", "id"], "left").filter("had is null or place < had").drop("had"))
        seen = seen.unionByName(near)
    return seen.groupBy("question", "id").agg(F.min(F.struct("place", "hop")).alias("o")).select("question", "id", "o.place", "o.hop")


def shared_surroundings(edges: DataFrame, about: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """What surroundings gives, and about, id: what is around each node that any question is about, which is searched once."""
    nodes = about.select(F.col("id").alias("question"), "id", F.lit(1).alias("place")).distinct()
    around = cut(surroundings(edges, nodes, hops).select(F.col("question").alias("about"), "id", "hop"))
    found = about.select("question", F.col("id").alias("about"), "place").join(around, "about").groupBy("question", "id").agg(F.min(F.struct("place", "hop")).alias("o"))
    return cut(found.select("question", "id", "o.place", "o.hop")), around.select("about", "id")


#: Questions, and vectors, of a block.
ASKED, COMPARED = 500, 20_000


def nearest_vectors(vectors: DataFrame, questions: DataFrame, k: int, threshold: float) -> DataFrame:
    """question, vec_id, similarity, rank: of each of questions (question, embedding) the k nearest vectors, and of them those at or over the threshold.

    Equal questions are compared once, in blocks of questions against blocks of
    vectors. A question or vector that is null, or as wide as none of the other
    kind, has no likeness, and nor has a vector of length 0.
    """
    asked = cut(questions.select("question", "embedding").filter("embedding is not null"))
    each = cut(asked.groupBy("embedding").agg(F.min("question").alias("asked")))
    vectors = vectors.select("vec_id", "embedding").filter("embedding is not null")
    i, j = max(1, -(-each.count() // ASKED)), max(1, -(-vectors.count() // COMPARED))
    spread = lambda df, c, n: df.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = spread(each.withColumn("i", F.pmod(F.xxhash64("asked"), F.lit(i)).cast("int")), "j", j)
    right = spread(vectors.withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(j)).cast("int")), "i", i)

    def run(key, mine, others):
        import pandas as pd

        none = pd.DataFrame({"asked": [], "vec_id": [], "similarity": []})
        parts = [none]
        for wide, group in mine.groupby(mine["embedding"].map(len)):
            rows = others[others["embedding"].map(len) == wide]
            if not wide or not len(rows):
                continue
            q, x, ids = np.stack(group["embedding"].to_list()).astype(float), np.stack(rows["embedding"].to_list()).astype(float), rows["vec_id"].to_numpy()
            q, size = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.linalg.norm(x, axis=1)
            for name, one in zip(group["asked"], q):
                like = np.where(size > 0, (x @ one) / np.maximum(size, 1e-300), -2.0).round(9)
                best = np.lexsort((ids, -like))[:k]
                best = best[like[best] >= -1]
                parts.append(pd.DataFrame({"asked": name, "vec_id": ids[best], "similarity": like[best]}))
        return pd.concat(parts) if len(parts) > 1 else none

    kind = dict(each.dtypes)["asked"]
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, f"asked {kind}, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("similarity"), "vec_id"))
    found = found.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("similarity") >= threshold))
    return asked.join(each, "embedding").select("question", "asked").join(cut(found), "asked").select("question", "vec_id", "similarity", "rank")


def merged_ranking(graph: DataFrame, vector: DataFrame, weight: float = 0.4, constant: int = 60) -> DataFrame:
    """question, document_id, score, graph_rank, vector_rank, rank of reciprocal rank fusion for many questions; of equal scores the smaller document."""
    both = graph.select("question", "document_id", F.col("rank").alias("graph_rank")).join(vector.select("question", "document_id", F.col("rank").alias("vector_rank")), ["question", "document_id"], "full")
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(constant) + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part(weight, "graph_rank") + part(1 - weight, "vector_rank"), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "document_id"))).select("question", "document_id", "score", "graph_rank", "vector_rank", "rank")


def graph_documents(found: DataFrame, entities: DataFrame) -> DataFrame:
    """question, document_id, rank: the documents of found nodes by first appearance (place, hop, name, id). entities has source_doc_id."""
    named = found.join(entities.select("id", "name", F.col("source_doc_id").alias("document_id")), "id").filter("document_id is not null")
    first = named.groupBy("question", "document_id").agg(F.min(F.struct("place", "hop", "name", "id")).alias("o"))
    return first.select("question", "document_id", F.row_number().over(Window.partitionBy("question").orderBy("o")).alias("rank"))


def nearest_documents(edges: DataFrame, about: DataFrame, entities: DataFrame, hops: int = 2) -> DataFrame:
    """What graph_documents gives for surroundings, without a row for each question and node.

    The first node (name, id) of each document at the end of so many steps is
    handed from node to node, once for all questions; as a shorter way comes
    first, steps that go back don't matter.
    """
    both = cut(undirected(edges).select("anchor", "other").filter("anchor <> other"))
    reach = [cut(about.select("id").distinct())]
    for _ in range(1, hops):
        step = both.join(reach[-1].withColumnRenamed("id", "anchor"), "anchor", "left_semi").select(F.col("other").alias("id"))
        reach.append(cut(reach[-1].unionByName(step).distinct()))
    named = entities.select("id", F.col("source_doc_id").alias("document_id"), "name").filter("document_id is not null")
    held = named.groupBy("id", "document_id").agg(F.min(F.struct("name", "id")).alias("first"))
    out = named.join(reach[0], "id", "left_semi").groupBy("id", "document_id").agg(F.min(F.struct("name", "id")).alias("first")).withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        ends = both.join(reach[hops - hop].withColumnRenamed("id", "anchor"), "anchor", "left_semi")
        held = cut(ends.join(held.withColumnRenamed("id", "other"), "other").groupBy(F.col("anchor").alias("id"), "document_id").agg(F.min("first").alias("first")))
        out = out.unionByName(held.join(reach[0], "id", "left_semi").withColumn("hop", F.lit(hop)))
    near = cut(out.groupBy("id", "document_id").agg(F.min(F.struct("hop", "first")).alias("o")))
    first = about.select("question", "id", "place").join(near, "id").groupBy("question", "document_id").agg(F.min(F.struct("place", "o")).alias("o"))
    return first.select("question", "document_id", F.row_number().over(Window.partitionBy("question").orderBy("o")).alias("rank"))


def context(found: DataFrame, entities: DataFrame, edges: DataFrame, graph_docs: DataFrame, documents: DataFrame, vector: DataFrame, token_budget: int = 8000, about: DataFrame | None = None, around: DataFrame | None = None) -> DataFrame:
    """question, context: what was found as a text.

    Names by type (25 each), different relationships (60), passages of the
    first five documents that name what was found (3,000 characters each; the
    first 1,500 of a document without any), cut at four characters a token; then
    the nearest passages (question, document_id, similarity, rank, text) up to
    two characters a token. documents: document_id, text. Every list is limited
    before it is gathered. With about (question, id, place) and what is around
    each of its nodes (see shared_surroundings), relationships are found once
    for each two of these nodes, not for each question.
    """
    nodes = cut(found.join(entities.select("id", "name", "entity_type"), "id"))
    by_type = Window.partitionBy("question", "entity_type")
    few = nodes.withColumn("r", F.row_number().over(by_type.orderBy("place", "hop", "name", "id"))).withColumn("n", F.count(F.lit(1)).over(by_type)).filter("r <= 25")
    lists = few.groupBy("question", "entity_type").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("r", "name"))).alias("names"))
    part = F.concat(F.lit("\n### "), F.col("entity_type"), F.lit("s ("), F.col("n").cast("string"), F.lit(")\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x["name"])), "\n"))
    types = lists.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_type", part.alias("t")))), lambda x: x["t"]), "\n").alias("types"))
    side = lambda c: nodes.select("question", F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    if around is None:
        ties = edges.select("source_id", "target_id", "rel_type").join(side("source"), "source_id").join(side("target"), ["question", "target_id"]).select("question", "source_name", "target_name", "rel_type").distinct()
    else:
        held = cut(around.join(entities.select("id", "name"), "id"))
        end = lambda c: held.select(F.col("about").alias(f"{c}_about"), F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
        tied = cut(edges.select("source_id", "target_id", "rel_type").join(end("source"), "source_id").join(end("target"), "target_id").select("source_about", "target_about", "source_name", "target_name", "rel_type").distinct())
        one = lambda c: about.select("question", F.col("id").alias(f"{c}_about"))
        ties = tied.join(one("source").join(one("target"), "question"), ["source_about", "target_about"]).select("question", "source_name", "target_name", "rel_type").distinct()
    of = Window.partitionBy("question")
    ties = ties.withColumn("r", F.row_number().over(of.orderBy("source_name", "target_name", "rel_type"))).withColumn("n", F.count(F.lit(1)).over(of)).filter("r <= 60")
    line = F.concat(F.lit("- "), F.col("source_name"), F.lit(" --["), F.col("rel_type"), F.lit("]--> "), F.col("target_name"))
    ties = ties.groupBy("question").agg(F.concat(F.lit("\n### Relationships ("), F.max("n").cast("string"), F.lit(" unique)\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x["t"]), "\n")).alias("ties"))
    docs = cut(graph_docs.filter("rank <= 5").join(documents, "document_id"))
    sentences = docs.select("question", "document_id", "rank", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n{2,}")).alias("at", "s")).withColumn("s", F.trim("s")).filter(F.length("s") >= 20)
    wanted = nodes.filter("entity_type <> 'Document' and name <> ''").select("question", F.lower("name").alias("name")).distinct()
    keys = wanted.select("question", "name", F.lit(3.0).alias("worth")).unionByName(wanted.select("question", F.explode(F.split("name", r"\s+")).alias("name")).filter(F.length("name") >= 3).distinct().withColumn("worth", F.lit(0.5)))
    scored = sentences.join(keys, "question").filter(F.contains(F.lower("s"), "name")).groupBy("question", "document_id", "rank", "at", "s").agg(F.sum("worth").alias("score"))
    best = Window.partitionBy("question", "document_id").orderBy(F.desc("score"), "at")
    kept = scored.withColumn("used", F.sum(F.length("s") + 2).over(best.rowsBetween(Window.unboundedPreceding, 0)) - 2).filter("used <= 3000")
    quoted = kept.groupBy("question", "document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "at", "s"))), lambda x: x["s"]), "\n\n").alias("quote"))
    excerpt = F.concat(F.trim(F.substring("text", 1, 1500)), F.when(F.length("text") > 1500, "...").otherwise(""))
    shown = docs.join(quoted, ["question", "document_id"], "left").withColumn("t", F.concat(F.lit("\n**"), F.col("document_id").cast("string"), F.lit("**:\n```\n"), F.coalesce("quote", excerpt), F.lit("\n```")))
    shown = shown.groupBy("question").agg(F.concat(F.lit("\n### Source Document Evidence ("), F.count(F.lit(1)).cast("string"), F.lit(" documents)\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n")).alias("docs"))
    fits = F.sum(F.length("text")).over(of.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) <= 2 * token_budget
    near = vector.filter("text <> ''").withColumn("fits", fits).filter("fits")
    near = near.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("[similarity="), F.format_string("%.3f", "similarity"), F.lit(", doc="), F.col("document_id").cast("string"), F.lit("]\n"), F.col("text")).alias("t")))), lambda x: x["t"]), "\n\n").alias("near"))
    all_ = types.join(ties, "question", "left").join(shown, "question", "left").join(near, "question", "full")
    text = F.concat_ws("\n", F.lit("## Intelligence Context from Knowledge Graph\n"), "types", "ties", "docs")
    text = F.when(F.length(text) > 4 * token_budget, F.concat(F.substring(text, 1, 4 * token_budget), F.lit("\n\n[Context truncated due to token budget]"))).otherwise(text)
    return all_.select("question", F.concat(text, F.when(F.col("near").isNotNull(), F.concat(F.lit("\n\n### Semantically Similar Document Passages\n"), "near")).otherwise("")).alias("context"))
