"""How far the sources of a language differ in their words.

Every kept term has a count in each source, a sparse vector, and most terms
share theirs with others (two of one source, one of another). Terms are grouped
by equal vectors; each pair of sources is evaluated once for each distinct
vector and multiplied by how many terms have it; original terms come back only
to be ranked. All arithmetic is on whole numbers: exact while a language has
fewer than 9 * 10**13 words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, released, schema_of, spread_join, texts

SCALE = 1_000_000_000
#: Sources are paired in tiles of so many, and vectors in blocks of so many.
TILE, VECTORS = 256, 20_000
#: A task hands its counts on when it holds so many.
HELD = 200_000

_FOLD = bytearray(b" " * 256)
_FOLD[0x61:0x7B] = bytes(range(0x61, 0x7B))
_FOLD[0x41:0x5B] = bytes(range(0x61, 0x7B))
_FOLD[0x80:] = bytes(range(0x80, 256))
_FOLD = bytes(_FOLD)


def words(data: bytes, block: int = 1 << 20):
    """Lists of the terms of a UTF-8 text: runs of ASCII letters, made small, and of all that isn't ASCII. Long texts are cut between terms."""
    data, at = data.translate(_FOLD), 0
    while at < len(data):
        end = len(data) if len(data) - at <= block else data.find(b" ", at + block)
        end = end if end >= 0 else len(data)
        yield data[at:end].split()
        at = end


def _count(batches):
    """lang, source, term, n (occurrences), d (documents), added up as far as memory lets."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            k = len(terms)
            yield pa.record_batch([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "d"])
        held.clear()

    for batch in batches:
        for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch, "text"), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in words(data):
                n.update(part)
                seen.update(part)
            d.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def kept_terms(ws: Workspace, docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, vec (source and n, by source), total, vid (a digest of vec) of terms in at least min_docs documents of their language."""
    rows = docs.mapInArrow(released(_count), schema_of("lang string, source string, term string, n long, d long"))
    # dealt by term once: both sums below keep to that
    by_source = rows.repartition(partitions(ws.spark), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec")).filter(F.col("d") >= min_docs)
    return ws.write(terms.select("lang", "term", "vec", "total", F.unhex(F.sha2(F.to_json("vec"), 256)).alias("vid")), "terms")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) by long division in two steps, so that nothing overflows."""
    up, over, step = f"(({count} + 2) * 100000L)", f"({total} + 2 * {terms})", SCALE // 100_000
    return F.expr(f"1 + ({up} div {over}) * {step} + (({up} % {over}) * {step}) div {over}")


def _shares(counts: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The same for rows of counts and what each column is divided by."""
    up = (counts + np.uint64(2)) * np.uint64(100_000)
    first, step = up // over, np.uint64(SCALE // 100_000)
    return np.uint64(1) + first * step + (up - first * over) * step // over


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pairs(_, entries, info):
    """Sums over the vectors of one block, for each pair of sources of two tiles (one and the same tile, or two)."""
    import pandas as pd

    names = ["lang", "a", "b", "value", "covered"]
    if not len(info):
        return pd.DataFrame({c: [] for c in names})
    info = info.sort_values("idx")
    idx, over = info["idx"].to_numpy(), (info["total"] + 2 * info["terms"]).to_numpy().astype(np.uint64)
    vec, row = np.unique(entries["vec_no"].to_numpy(), return_inverse=True)
    times = np.zeros(len(vec), np.uint64)
    times[row] = entries["m"].to_numpy().astype(np.uint64)
    col, n = np.searchsorted(idx, entries["idx"].to_numpy()), entries["n"].to_numpy().astype(np.uint64)
    tile, sums = idx // TILE, np.zeros((len(idx), len(idx)), np.uint64)
    apart = tile[0] != tile[-1]
    step = max(1, (1 << 21) // len(idx))
    order = np.argsort(row, kind="stable")
    row, col, n = row[order], col[order], n[order]
    for at in range(0, len(vec), step):
        lo, hi = np.searchsorted(row, [at, at + step])
        counts = np.zeros((min(step, len(vec) - at), len(idx)), np.uint64)
        counts[row[lo:hi] - at, col[lo:hi]] = n[lo:hi]
        p = _shares(counts, over).astype(np.int64)
        m = times[at : at + step]
        for s in range(len(idx) - 1):
            ends = np.searchsorted(tile, tile[s] + 1) if apart else s + 1
            if ends < len(idx) and (not apart or tile[s] == tile[0]):
                x, y = p[:, s : s + 1], p[:, ends:]
                gap = (x - y).astype(np.int64)
                sums[s, ends:] += ((gap * gap).astype(np.uint64) // (x + y).astype(np.uint64) * m[:, None]).sum(axis=0)
    a, b = np.triu_indices(len(idx), 1)
    if apart:
        other = tile[a] != tile[b]
        a, b = a[other], b[other]
    return pd.DataFrame({"lang": info["lang"].iloc[0], "a": idx[a], "b": idx[b], "value": sums[a, b].astype(np.int64), "covered": int(times.sum())})[names]


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Pairs (lang, source, item, value, rank), both ways, and the top terms of each source (same columns).

    Null texts, langs and sources are empty; '' is a lang and a source like
    others. Rows are documents whatever their ids, repeated ones too. A source
    without kept terms is there with counts of 0; a lang without kept terms has
    pairs of value 0. An empty table gives no rows. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = kept_terms(ws, docs, min_docs)
    vectors = terms.groupBy("lang", "vid").agg(F.first("vec").alias("vec"), F.first("total").alias("total"), F.count(F.lit(1)).alias("m"), F.min("term").alias("first"))
    vectors = ws.write(vectors.withColumn("vec_no", F.monotonically_increasing_id()), "vectors")
    loose = ws.write(vectors.select("lang", "vec_no", "vid", "m", "total", "first", F.explode("vec").alias("e")).select("*", "e.source", "e.n").drop("e"), "loose")
    langs = vectors.groupBy("lang").agg(F.sum("m").alias("terms"), F.sum(F.col("m") * F.col("total")).alias("lang_total"))
    sums = loose.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("total"), F.count(F.lit(1)).alias("entries"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    info = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0).withColumn("idx", place)
    info = info.withColumn("last", F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / TILE))
    info = ws.write(info, "groups")
    entries = ws.write(spread_join(loose, info.withColumnRenamed("total", "sum").withColumnRenamed("entries", "of"), ["lang", "source"], "of").drop("source", "of"), "entries")
    ws.drop("loose")
    return _pair_values(ws, entries, info, vectors), _top_terms(ws, entries, info, terms, top)


def _pair_values(ws: Workspace, entries: DataFrame, info: DataFrame, vectors: DataFrame) -> DataFrame:
    blocks = max(1, -(-vectors.count() // VECTORS))
    mine = F.floor(F.col("idx") / TILE)
    paired = lambda df: df.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumn("i", F.least(mine, "u")).withColumn("j", F.greatest(mine, "u")).drop("last", "u")
    left = paired(entries.select("lang", "vec_no", "m", "idx", "n", "last")).withColumn("block", F.pmod(F.hash("vec_no"), F.lit(blocks)))
    right = paired(info.select("lang", "idx", "total", "terms", "last")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["lang", "i", "j", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pairs, schema_of("lang string, a long, b long, value long, covered long"))
    sums = ws.write(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered")), "pairs")
    side = lambda c: info.select("lang", F.col("idx").alias(c), F.col("source").alias(f"{c}_source"), F.when(F.col("terms") > 0, _share("0", "total", "terms")).alias(f"{c}_p"), F.col("terms").alias(f"{c}_terms"))
    named = sums.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    # the terms that neither source has: all of them differ by as much
    value = F.col("value") + (F.col("a_terms") - F.col("covered")) * F.coalesce(_apart("a_p", "b_p"), F.lit(0))
    both = named.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("e"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "e.source", "e.item", "value").withColumn("rank", F.row_number().over(w))


def _top_terms(ws: Workspace, entries: DataFrame, info: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """A term among the first top is among the first top terms of its vector, and its vector among the first top by value and first term."""
    scored = entries.select("lang", "vid", "first", F.col("idx"), _share("n", "`sum`", "terms").alias("p"), _share("total", "lang_total", "terms").alias("q")).filter("p > q")
    scored = scored.withColumn("value", _apart("p", "q"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("lang", "idx").orderBy(F.desc("value"), "first"))).filter(F.col("r") <= top)
    few = terms.select("lang", "vid", "term").withColumn("r", F.row_number().over(Window.partitionBy("lang", "vid").orderBy("term"))).filter(F.col("r") <= top)
    found = best.drop("r", "first").join(few.drop("r"), ["lang", "vid"])
    w = Window.partitionBy("lang", "idx").orderBy(F.desc("value"), "term")
    ranks = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranks.join(info.select("lang", "idx", "source"), ["lang", "idx"]).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def query(docs: DataFrame) -> DataFrame:
    """Both parts of the audit in one table; see audit."""
    pairs, terms = audit(docs)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(x.total), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) x USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (g.total + 2 * l.v) AS HUGEINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS HUGEINT) AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
everyone AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM everyone
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranks WHERE part = 'pair' OR rank <= 10"""
