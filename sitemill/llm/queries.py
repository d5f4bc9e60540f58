"""Registered queries of the subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitemill.llm import exact_dedup, filter_audit, lexical_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, encoded by overlapping chunks and decoded again."""
    import public_tokenizers

    from sitemill.llm.byte_bpe import digests

    return digests(_table(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages, by rules and path-template trees."""
    from sitemill.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, by site template removal."""
    from sitemill.llm.page_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit-decreasing packing of all documents into sequences of 2048 tokens."""
    from sitemill.llm.packing import packed_documents

    return packed_documents(_table(spark, sf_dir, "documents"), _tokenizer_file("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by an extendible-hash index."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents, by patience alignment."""
    from sitemill.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of 3-word shingles of at least 0.9."""
    from sitemill.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label, by an epsilon grid order join."""
    from sitemill.llm.vector_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: importance weights and the Gumbel top-k draw."""
    from sitemill.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the rows that are not held out."""
    from sitemill.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order, by language."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of repeated 400-byte strings from all documents, by merged Burrows-Wheeler transforms."""
    from sitemill.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item, by the Best Position Algorithm."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {
    "op2_vector_join": op2_vector_join,
    "op3_importance_resampling": op3_importance_resampling,
    "op1_byte_bpe": op1_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_page_text": op5_page_text,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_lexical_search": op13_lexical_search,
}
LLM_ORACLES: dict[str, str] = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
