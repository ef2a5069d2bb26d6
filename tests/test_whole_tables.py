"""Queries that must read the whole of their tables."""

from pyspark.sql import functions as F

from sleuthgrid.functions import text
from sleuthgrid.plans import catalog, network_queries, queries  # noqa: F401  registers the queries
from tests.test_queries import DATA


def test_all_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    with_words = docs.filter(F.size(text.tokens(F.col("text"))) > 0)
    assert with_words.filter("lang <> 'en'").count()
    got = catalog.QUERIES["m1_tf_idf"](spark, DATA).select("doc_id").distinct()
    assert with_words.join(got, "doc_id", "left_anti").count() == 0
    assert catalog.QUERIES["f11_tokens"](spark, DATA).filter("n <= 5").count()
