"""A pipeline over documents: each stage is written as Parquet and read by the next.

STAGES: toxicity (rejected documents go), near_dedup (one document of each
group stays), substring_dedup (repeated passages go from the texts),
decontaminate (documents that hold a benchmark item go), encode (ids of each
text, with digests).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthgrid.llm import decontaminate as _decontaminate
from sleuthgrid.llm import minhash, piece_spans, substring_dedup, toxicity
from sleuthgrid.llm.common import Workspace, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted toxic.

    A row without doc_id is judged by its text like others, and so is each of
    rows that repeat; null and empty texts stay; an empty table gives none.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.clean(docs.select(*COLUMNS), model)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: of its smallest doc_id, a null one first, and of several texts of that id the first class's.

    Rows are matched by id and text: different texts may share a doc_id or have
    none. Null and empty texts are one group; an empty table gives none.
    """
    keep = minhash.near_duplicates(docs).select(F.col("group_key").alias("key")).distinct()
    rows = docs.select(*COLUMNS).withColumn("key", minhash.text_key(F.col("doc_id"), F.col("text"))).join(keep, "key", "left_semi")
    others = [c for c in COLUMNS if c != "text"]  # of rows that share id and text, the first by the other columns
    return rows.groupBy("key").agg(F.min(F.struct(*others, "text")).alias("row")).select(*[F.col(f"row.{c}") for c in COLUMNS])


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows of words from the texts; a document of which nothing stays goes.

    A text that loses nothing stays as it is, white space too; a null one is
    empty. n_chars is that of the text that stays. An empty table gives none.
    """
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS), with_text=True).filter("n_removed = 0 or n_removed < n_words")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item.

    Rows are matched by id and text, so of different texts that share a doc_id,
    or have none, only those with an item go. An empty table, of documents or
    of items, takes nothing away.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", minhash.text_key(F.col("doc_id"), F.col("text")))
    found = _decontaminate.passages(keyed.select("key", "text"), read_table(spark, sf_dir, "benchmark"), keys=("key",))
    hits = Workspace(spark, "decontaminate").write(found.select("key").distinct(), "hits")
    return keyed.join(hits, "key", "left_anti").select(*COLUMNS)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text, as digests of ids and of what they decode to; a null text is empty, rows repeat as they are."""
    return piece_spans.encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("substring_dedup", stage_substring_dedup),
    ("decontaminate", stage_decontaminate),
    ("encode", stage_encode),
]

#: SQL can express neither a learned model nor an alignment; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
