"""Quality by importance resampling: two hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligatable.llm.common import LOWER, hash_table, kth_largest, pieces, rows_out, small_batches, utf8, word_hashes
from ligatable.session import cut_lineage

BUCKET_BITS = 15
#: Labelled target documents that the target model reads at most.
TARGET_DOCS = 20_000

COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_ratio", pa.float64())])


def buckets(text: bytes, table: np.ndarray, bits: int) -> np.ndarray:
    """Hash buckets of all words and word pairs of a text."""
    words, _, _ = word_hashes(text.translate(LOWER), table)
    mixed = words * np.uint64(0x9E3779B97F4A7C15)
    pairs = mixed[:-1] * np.uint64(3) + mixed[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate((mixed, pairs)) >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(docs: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``(bucket, target, raw)`` over all of ``docs (text, is_target)``.

    A task adds up its own rows and sends at most one row a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hash_table()
        target, raw = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for piece in pieces(batches):
            for text, wanted in zip(utf8(piece.column(0)), piece.column(1).to_pylist()):
                counts = np.bincount(buckets(text, table, bits), minlength=1 << bits)
                raw += counts
                if wanted:
                    target += counts
        seen = np.flatnonzero(raw)
        yield rows_out(COUNTS, [seen.astype(np.int32), target[seen], raw[seen]])

    rows = docs.select(F.col("text").cast("string"), "is_target").mapInArrow(run, "bucket int, target long, raw long")
    return rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """Log of target over raw probability by bucket, both smoothed by one.

    At most ``2 ** bits`` rows come to the driver.
    """
    target, raw = np.ones(1 << bits), np.ones(1 << bits)
    for row in counts.collect():
        target[row.bucket] += row.target
        raw[row.bucket] += row.raw
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importance_sample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    seed: int = 11,
    target_docs: int = TARGET_DOCS,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """``doc_id, n_grams, log_ratio, gumbel_key, selected`` of every row of ``docs``.

    Two bags of hashed words and word pairs are counted: one over the target, documents
    that ``labels (doc_id, quality, toxic)`` calls good and not toxic (at most
    ``target_docs`` of them, by hash of the id), one over all documents. A document's
    ``log_ratio`` is its log probability under the first less that under the second.
    Adding Gumbel noise, seeded by the id, and taking the ``k`` largest draws ``k``
    documents without replacement in proportion to their importance. ``k`` is ``share``
    of all rows; without it, the share of good ones among the labelled.

    Null, empty and blank texts have no n-grams and ratio zero. Rows that repeat an id
    share its noise, rows without id share one; rows that tie at the cut are all
    selected. Without labels nothing is known of the target, so ratios are those of an
    empty count, and all rows are selected. Only ``doc_id`` and ``text`` are read.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null")
    good = known.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("labelled")).distinct()
    if share is None:
        n_known, n_good = known.select("doc_id").distinct().count(), good.count()
        share = n_good / n_known if n_known else 1.0
    # at most target_docs ids of eight bytes
    target = F.broadcast(good.orderBy(F.xxhash64(F.lit(seed), "labelled"), "labelled").limit(target_docs))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    marked = texts.join(target, F.col("doc_id") == F.col("labelled"), "left").select(
        "text", F.col("labelled").isNotNull().alias("is_target")
    )
    ratios = log_ratios(gram_counts(marked, bits), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hash_table()
        for piece in pieces(batches):
            found = [buckets(t, table, bits) for t in utf8(piece.column(1))]
            sums = [float(ratios[b].sum()) for b in found]
            yield rows_out(SCORES, [piece.column(0), [len(b) for b in found], sums])

    scored = texts.mapInArrow(run, "doc_id long, n_grams long, log_ratio double")
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12) + F.lit(0.5)) / F.lit(float(2**52))
    keyed = cut_lineage(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(draw))))
    cut = kth_largest(keyed, "gumbel_key", round(share * keyed.count()))
    selected = F.lit(False) if cut is None else F.col("gumbel_key") >= F.lit(cut)
    return keyed.withColumn("selected", selected)
