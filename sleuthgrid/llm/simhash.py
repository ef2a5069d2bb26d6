"""SimHash fingerprints and search within a Hamming radius, in DataFrame functions alone.

A term is a word with the word before it (the first word stands with an empty
one), so word order counts and a text of one word has a term. A term's weight
is how often it occurs. Each term's 64-bit hash votes on every bit; a bit of
the fingerprint is set if the terms that have it outweigh those that lack it.

Votes are counted two to a long: ``(hash >> k) & 0x0000000100000001`` has bit k
in the low half and bit k + 32 in the high half, so 32 sums hold the 64 counts
and no count can overflow into the next for a text of under 2**32 words.
Aggregation is partial on the mapping side: a text is never shuffled as terms.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions, with_next

_LANES = 0x0000000100000001


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\n\u000b\f\r]+"), lambda w: w != "")


def terms(words: Column) -> Column:
    """Hashes of the terms of a text's words: array<bigint>, empty if it has none. Pass a column, not an expression to be worked out twice."""
    before = F.slice(F.concat(F.array(F.lit("")), words), F.lit(1), F.size(words))
    return F.zip_with(words, before, lambda w, b: F.xxhash64(w, b))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(df: DataFrame, arrays: list[tuple[int, str]], keys: list[str]) -> DataFrame:
    """One row for each row of df and each (number, array column): keys, which, n_terms, fp. keys must identify a row."""
    parts = F.array(*[F.struct(F.lit(n).alias("which"), F.col(c).alias("terms")) for n, c in arrays])
    exploded = df.select(*keys, F.inline(parts)).select(*keys, "which", F.explode_outer("terms").alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES))).alias(f"v{k}") for k in range(32)]
    counted = exploded.groupBy(*keys, "which").agg(F.count("h").alias("n_terms"), *votes)
    half = F.col("n_terms") / 2
    low = [F.when(F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) > half, F.lit(_signed(1 << k))).otherwise(F.lit(0)) for k in range(32)]
    high = [F.when(F.shiftrightunsigned(F.col(f"v{k}"), 32) > half, F.lit(_signed(1 << (k + 32)))).otherwise(F.lit(0)) for k in range(32)]

    def together(bits: list[Column]) -> Column:
        out = bits[0].cast("long")
        for b in bits[1:]:
            out = out.bitwiseOR(b.cast("long"))
        return out

    halves = counted.select(*keys, "which", "n_terms", *[together(x).alias(f"p{i}") for i, x in enumerate((low[:16], low[16:], high[:16], high[16:]))])
    return halves.select(*keys, "which", "n_terms", F.col("p0").bitwiseOR(F.col("p1")).bitwiseOR(F.col("p2")).bitwiseOR(F.col("p3")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of differing bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hamming_pairs(queries: DataFrame, base: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """For each distinct ``fp`` of queries, the distinct fingerprints of base within radius, and how many rows of base have each: q_fp, fp, n.

    A join with base on fp gives the rows themselves.

    The bits are cut into blocks; of any two fingerprints within radius, at
    least ``blocks - radius`` blocks agree. So for each choice of that many
    blocks a table is keyed by them, which is the permuted table of that
    choice, and every pair within radius meets in one. A pair is taken only in
    the first table where it meets. Equal fingerprints are counted before the
    join, so copies make no pairs; a null fingerprint has no neighbours.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [_signed(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i]) for i in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))

    def mask(choice) -> int:
        out = 0
        for i in choice:
            out |= masks[i] & (1 << 64) - 1
        return _signed(out)

    def tables(df: DataFrame, fp: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col(fp).bitwiseAND(F.lit(mask(c)).cast("long")).alias("block")) for t, c in enumerate(choices)])
        return df.select("*", F.inline(keys))

    q = tables(queries.select(F.col("fp").alias("q_fp")).filter("q_fp is not null").distinct(), "q_fp")
    b = tables(base.filter("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp")
    differ = F.col("q_fp").bitwiseXOR(F.col("fp"))
    agree = [differ.bitwiseAND(F.lit(m).cast("long")) == 0 for m in masks]
    # a choice comes before another if it takes the earlier blocks: the first is of the first agreeing blocks
    rank = F.lit(0)
    first = F.lit(True)
    for i in range(blocks):
        chosen = F.element_at(F.array(*[F.lit(i in c) for c in choices]), F.col("table") + 1)
        first = first & (chosen == (agree[i] & (rank < blocks - radius)))
        rank = rank + agree[i].cast("int")
    return q.join(b.withColumnRenamed("table", "b_table").withColumnRenamed("block", "b_block"), (F.col("table") == F.col("b_table")) & (F.col("block") == F.col("b_block")) & (F.bit_count(differ) <= radius) & first).select("q_fp", "fp", "n")


def hamming_search(queries: DataFrame, base: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """For each distinct ``fp`` of queries, how many rows of base have a fingerprint within radius: fp, n_within."""
    return hamming_pairs(queries, base, radius, blocks).groupBy(F.col("q_fp").alias("fp")).agg(F.sum("n").alias("n_within"))


def edited_fingerprints(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """Fingerprint each whole text and its edited text, compare, and search.

    The edited text has the last quarter of the code points replaced by as many
    from the start of the next document by doc_id. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited,
    near_next, and n_within: for each doc_id divisible by every, the documents
    whose fingerprint lies within radius of its own, itself among them; null
    for the other rows. A null text counts as empty; an empty text has
    fingerprint 0; a null doc_id sorts first; rows of equal doc_id are ordered
    by text and stay rows of their own; a table without rows gives none; other
    columns of docs are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    n = partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(base, "doc_id", "text", "after", n)
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    paired = paired.select("doc_id", size.cast("long").alias("n_chars"), "text", F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("after"), F.lit(1), cut)).alias("edited"))
    sha = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    keyed = paired.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", *quarters, words(F.col("text")).alias("w0"), words(F.col("edited")).alias("w1"))
    keyed = keyed.withColumns({"t0": terms(F.col("w0")), "t1": terms(F.col("w1"))})
    keys = ["row", "doc_id", "n_chars", "s0", "s1", "s2", "s3"]
    fp = fingerprints(keyed, [(0, "t0"), (1, "t1")], keys)
    both = fp.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    table = ws.write(both.drop("row"), "fingerprints")
    found = hamming_search(table.filter(F.col("doc_id") % every == 0), table, radius)
    nexts = with_next(table, "doc_id", "fp", "next_fp", n)
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    counted = nexts.withColumn("q", F.when(F.col("doc_id") % every == 0, F.col("fp"))).join(found.select(F.col("fp").alias("q"), "n_within"), "q", "left")
    return counted.select(
        "doc_id",
        "n_chars",
        F.concat(*[hexed(f"s{i}") for i in range(4)]).alias("edited_sha256"),
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_within",
    )
