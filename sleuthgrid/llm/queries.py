"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import edited_fingerprints

    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import query

    return query(read_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs, tokenizer("piece_bpe_32k.model")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_files

    return token_files(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import passages

    return passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_revisit import query

    return query(read_table(spark, sf_dir, "pages"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_spans import encode_pieces

    return encode_pieces(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    from .prefix_trie import query

    return query(read_table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in the sequences."""
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and the terms that set each source apart."""
    from .divergence import query

    return query(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_substring_dedup": op2_substring_dedup, "op3_token_files": op3_token_files, "op4_benchmark_passages": op4_benchmark_passages, "op5_revisits": op5_revisits, "op6_pieces": op6_pieces, "op7_language": op7_language, "op8_minhash": op8_minhash, "op9_simhash": op9_simhash, "op10_html_text": op10_html_text, "op11_prefix_trie": op11_prefix_trie, "op12_packing": op12_packing, "op13_source_divergence": op13_source_divergence, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from . import divergence, prefix_trie, warc_revisit

    return {"op13_source_divergence": divergence.SQL, "op5_revisits": warc_revisit.SQL, "op11_prefix_trie": prefix_trie.SQL}
