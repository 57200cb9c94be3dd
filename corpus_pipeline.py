"""A corpus from raw documents: filter by language, deduplicate, decontaminate, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ligatable.llm import ball_simhash, byte_langid, line_spread, mixing, suffix_automaton
from ligatable.llm.common import read
from ligatable.session import drop_staged, staging_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; the others go."""
    return byte_langid.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on several sites, short ones on more, stay where they occur first."""
    return line_spread.deduplicated_lines(docs, short_sites=line_spread.SHORT_SITES)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link at three or fewer bits."""
    return ball_simhash.one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them go."""
    return suffix_automaton.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources meet their target weights."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("source_mix", mix),
]

#: The first stage is a trained network and the third meets variants of fingerprints: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next.

    What a stage has read goes when its result is written; the table that the returned
    rows are read from stays.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = staging_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_staged(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
