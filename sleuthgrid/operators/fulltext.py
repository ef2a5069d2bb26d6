"""Full-text lookup by an inverted index whose blocks know their greatest score.

Documents are dealt into blocks, the same for all terms. For a query, a block
can't hold a better document than the sum of its terms' greatest scores there.
The blocks that promise most are scored first; the score of the n-th document
found is then a bound, and only blocks that promise as much are scored at all.
The result is that of scoring everything. Documents with the same words, as
often each, have one score: they are one entry, known by its smallest id, and
so are queries with the same words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut, split_join

#: BM25's weights of term counts and of length (the usual values).
K1, B = 1.2, 0.75
#: Documents of a block, and how many blocks of a query are scored first.
BLOCK, FIRST = 128, 8


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


@dataclass
class Index:
    """postings (term, block, id: an entry, part: what the term gives it but for its idf), tops (term, block, top, n), terms (term, idf), entries (entry, id)."""

    postings: DataFrame
    tops: DataFrame
    terms: DataFrame
    entries: DataFrame

    def save(self, folder: str) -> None:
        for name in ("postings", "tops", "terms", "entries"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def open(cls, spark, folder: str) -> Index:
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in ("postings", "tops", "terms", "entries")])


def build(docs: DataFrame) -> Index:
    """Of docs (id, text). A null text is empty; an id that comes twice is one document of both texts."""
    words = docs.select("id", F.explode(terms_of(F.col("text"))).alias("term"))
    counts = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    each = cut(counts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("words"), F.sum("tf").alias("length")))
    n = docs.select("id").distinct().count()
    mean = (each.agg(F.sum("length")).head()[0] or 0) / max(1, n)
    alike = cut(each.groupBy("words", "length").agg(F.min("id").alias("entry"), F.count(F.lit(1)).alias("n")))
    entries = cut(split_join(each.select("id", "words"), alike.select("words", "entry", "n"), ["words"], "n").select("entry", "id"))
    blocks = max(1, -(-alike.count() // BLOCK))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(max(mean, 1e-9))))
    postings = alike.select(F.col("entry").alias("id"), "length", "n", F.inline("words")).select("term", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", part.alias("part"), "n")
    postings = cut(postings)
    tops = cut(postings.groupBy("term", "block").agg(F.max("part").alias("top"), F.sum("n").alias("n")))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(postings.drop("n"), tops, cut(tops.groupBy("term").agg(F.sum("n").alias("df")).select("term", idf.alias("idf"))), entries)


def _score(wanted: DataFrame, blocks: DataFrame, postings: DataFrame) -> DataFrame:
    """query, id, score of every document of the blocks (query, block)."""
    asked = wanted.join(blocks.select("query", "block"), "query")
    return asked.join(postings, ["term", "block"]).groupBy("query", "id").agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("score"))


def search(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """query, id, score, rank: the n best documents of each of queries (query, text) by BM25, of equal scores the smaller id.

    A query's repeated words count as often as they are there. Queries without
    a word that the index has give no rows; see containing.
    """
    words = queries.select("query", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    words = cut(words.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("words")))
    alike = cut(words.groupBy("words").agg(F.min("query").alias("as"), F.count(F.lit(1)).alias("n")))
    same = split_join(words, alike, ["words"], "n").select("query", "as")
    words = alike.select(F.col("as").alias("query"), F.inline("words"))
    wanted = cut(words.join(index.terms, "term").select("query", "term", (F.col("times") * F.col("idf")).alias("weight")))
    bounds = cut(wanted.join(index.tops, "term").groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    first = cut(bounds.withColumn("place", place).filter(F.col("place") <= FIRST))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    early = cut(_score(wanted, first, index.postings).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n))
    floor = early.filter(F.col("rank") == n).select("query", F.col("score").alias("floor"))
    rest = bounds.join(first.select("query", "block"), ["query", "block"], "left_anti").join(floor, "query", "left")
    rest = rest.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-5))
    all_ = early.drop("rank").unionByName(_score(wanted, rest, index.postings))
    # the n best documents are among the n smallest ids of each of the n best entries
    entries = all_.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select(F.col("query").alias("as"), F.col("id").alias("entry"), "score")
    entries = cut(entries)
    held = index.entries.join(entries.select("entry").distinct(), "entry", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).filter(F.col("r") <= n)
    ranked = entries.join(held, "entry").withColumn("rank", F.row_number().over(Window.partitionBy("as").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= n)
    return same.join(cut(ranked.select("as", "id", "score", "rank")), "as").select("query", "id", "score", "rank")


def containing(docs: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query, id, rank: the n smallest ids of docs (id, text) whose text contains that of the query (query, text), without case.

    Pairs are found by the query's first three characters (or as many as it
    has), not by comparing all with all, and once for queries and for texts
    that are the same. An empty query finds nothing.
    """
    named = cut(queries.select("query", F.lower("text").alias("q")).filter("q <> ''"))
    asked = named.select("q").distinct().withColumn("gram", F.substring("q", 1, 3))
    sizes = [r[0] for r in asked.select(F.length("gram")).distinct().collect()]  # 1, 2 or 3
    if not sizes:
        return named.select("query", F.lit(None).cast(docs.schema["id"].dataType).alias("id"), F.lit(0).alias("rank")).limit(0)
    text = F.lower("text")
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    grams = F.array_distinct(F.flatten(F.array(*[F.when(F.length(text) >= k, at(k)).otherwise(F.array().cast("array<string>")) for k in sizes])))
    texts = docs.select("text").filter("text is not null").distinct()
    held = texts.select("text", text.alias("t"), F.explode(grams).alias("gram"))
    found = cut(held.join(asked, "gram").filter(F.contains("t", "q")).select("q", "text"))
    ids = docs.select("id", "text").join(found.select("text").distinct(), "text", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("text").orderBy("id"))).filter(F.col("r") <= n).drop("r")
    found = found.join(ids, "text").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("id"))).filter(F.col("rank") <= n)
    return named.join(cut(found.select("q", "id", "rank")), "q").select("query", "id", "rank")


def lookup(index: Index, docs: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """query, id, rank: what search finds, and for queries without any what containing finds."""
    found = cut(search(index, queries, n).select("query", "id", "rank"))
    missed = queries.join(found.select("query").distinct(), "query", "left_anti")
    return found.unionByName(containing(docs, cut(missed), n).select("query", "id", "rank"))
