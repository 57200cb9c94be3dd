"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligatable.llm import (
    alignment,
    ball_simhash,
    block_labeller,
    byte_langid,
    gated_lm,
    line_spread,
    mixing,
    permutation_index,
    phrases,
    quality,
    suffix_automaton,
    token_counts,
    url_rules,
)
from ligatable.llm.common import read

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_document_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.document_scores(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_langid.languages(read(spark, sf_dir, "documents"))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines, and a digest of what is left."""
    done = line_spread.without_boilerplate(read(spark, sf_dir, "documents"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.length("text").cast("long").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def op6_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_quotas(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.main_text(read(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return alignment.aligned_documents(documents, tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(read(spark, sf_dir, "pages"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_sample": op1_importance_sample,
        "op2_permutation_index": op2_permutation_index,
        "op3_document_score": op3_document_score,
        "op4_language_id": op4_language_id,
        "op5_line_spread": op5_line_spread,
        "op6_ball_simhash": op6_ball_simhash,
        "op7_source_mix": op7_source_mix,
        "op8_token_counts": op8_token_counts,
        "op9_decontamination": op9_decontamination,
        "op10_main_text": op10_main_text,
        "op11_token_alignment": op11_token_alignment,
        "op12_collocations": op12_collocations,
        "op13_url_filter": op13_url_filter,
    }
