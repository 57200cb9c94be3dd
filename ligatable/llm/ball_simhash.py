"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligatable.llm.common import LOWER, pieces, rows_out, small_batches, utf8
from ligatable.llm.components import connected_components
from ligatable.session import cut_lineage, staging_path

SEED = 42
RADIUS = 3
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of all words if fewer."""
    found = text.translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - width + 1].tolist()
    cuts = zip(starts, ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes, as a signed long; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs (doc_id, text)``, from the whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            prints = [fingerprint(shingle_hashes(t, width)) for t in utf8(piece.column(1))]
            yield rows_out(PRINTS, [piece.column(0), prints])

    picked = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return picked.mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _literals(masks: list[int]) -> Column:
    return F.array(*(F.lit(_signed(m)) for m in masks)) if len(masks) < 50 else F.expr(
        "array(" + ",".join(f"{_signed(m)}L" if _signed(m) > -(1 << 63) else "shiftleft(1L, 63)" for m in masks) + ")"
    )


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of ``blocks - radius`` blocks: close fingerprints agree on one of them."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(one, blocks - radius)]


def crowded(prints: DataFrame, blocks: int) -> DataFrame:
    """The ``fp`` of ``prints`` that agree with another one on all but three blocks.

    Any two fingerprints with three or fewer differing bits do. What is left out has
    no neighbour, so its ball need not be hashed; what is kept is decided by its ball.
    """
    keyed = prints.select("fp", F.explode(_literals(block_masks(blocks))).alias("m")).select(
        "fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("v")
    )
    shared = keyed.groupBy("m", "v").agg(F.count("*").alias("n")).filter("n > 1").select("m", "v")
    return keyed.join(shared, ["m", "v"], "left_semi").select("fp").distinct()


def ball_masks() -> tuple[list[int], list[int]]:
    """Flips that even and that odd fingerprints emit, so that radius 3 meets in the middle.

    All emit themselves and every single flip, which covers distances 1 and 2. At
    distance 3 one of the two is even, and of the three bits two lie in the same half of
    the word: the even one flips these two, the odd one the third.
    """
    singles = [0] + [1 << i for i in range(64)]
    pairs = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return singles + pairs, singles


def ball_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` at three or fewer differing bits.

    Rows meet on variants. Whatever meets there lies within two flips of the variant, so
    at most 2,081 fingerprints share one, however large a group of near copies is. A
    member within one flip is within three bits of all others: linking each to such a
    centre keeps everything connected with one link a row. Each link is verified.
    """
    even, odd = ball_masks()
    is_even = F.bit_count("fp") % 2 == 0
    variants = prints.filter(is_even).select("fp", F.explode(_literals(even)).alias("m")).unionByName(
        prints.filter(~is_even).select("fp", F.explode(_literals(odd)).alias("m"))
    )
    near = F.when(F.bit_count("m") <= 1, F.col("fp"))
    met = variants.select("fp", "m", F.col("fp").bitwiseXOR(F.col("m")).alias("z")).select(
        "fp", F.min(near).over(Window.partitionBy("z")).alias("centre")
    )
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= RADIUS
    return met.filter("fp <> centre").filter(close).select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def component_labels(nodes: DataFrame, blocks: int) -> DataFrame:
    """Add ``label``, the smallest ``fp`` of the component, to ``nodes`` with distinct ``fp``."""
    labels = connected_components(ball_links(crowded(nodes.select("fp"), blocks)))
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )


def near_duplicates(docs: DataFrame, width: int = 3, blocks: int = 6) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs (doc_id, text)``.

    Words are separated by ASCII white space, A-Z lower-cased; ``width``-word shingles
    are hashed by XXH64. Null, empty and blank texts have fingerprint zero, linked like
    any other. Two fingerprints link at three or fewer differing bits, and a component
    is named by its smallest ``doc_id`` (null only if all its ids are). Repeated rows
    come back each; ids that stand on several texts belong to each text's component.
    Other columns are not read. No documents give no rows.

    Equal fingerprints are one node, so copies cost one row each. ``blocks`` sets the
    pre-check of ``crowded``: it passes on the more, the fewer bits its keys have (32 at
    6 blocks, 45 at 10); take more blocks from about a billion distinct texts on.
    """
    prints = cut_lineage(fingerprints(docs, width))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labelled = component_labels(nodes, blocks)
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "label").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, width: int = 3, blocks: int = 6) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``, whatever its ids.

    The row with the smallest ``doc_id`` stays, ties to the smaller hash of the text; rows
    without id come last. Copies without id, and an id that stands on several texts, are
    thus treated by text. All columns come back, whatever their names. No documents give
    no rows.

    Rows are numbered in a written copy, so that the last join meets on unique numbers and
    no group of copies meets in one task; only it moves whole rows.
    """
    spark = docs.sparkSession
    path = staging_path(spark, "numbered")
    docs.select(
        F.monotonically_increasing_id().alias("at"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("h"),
        F.struct("*").alias("row"),
    ).write.parquet(path)
    numbered = spark.read.parquet(path)
    prints = cut_lineage(fingerprints(numbered.select(F.col("at").alias("doc_id"), "row.text"), width))
    nodes = cut_lineage(prints.select("fp").distinct())
    # nulls are the smallest in Spark's order, so the flag goes in front
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "at")).alias("first")
    chosen = (
        prints.withColumnRenamed("doc_id", "at")
        .join(component_labels(nodes, blocks), "fp")
        .join(numbered.select("at", "doc_id", "h"), "at")
        .groupBy("label")
        .agg(first)
        .select("first.at")
    )
    return numbered.join(chosen, "at", "left_semi").select("row.*")
