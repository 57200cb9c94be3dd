"""What several operators share: folds, row keys, Arrow pieces and text helpers."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that an Arrow batch of whole texts holds at most, so that very long texts fit.
TEXT_ROWS = 512
#: A-Z to a-z; every other byte stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows that a histogram or its last bin brings to the driver at most.
BINS = 4096
SPACES = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Before Python tasks: batches of few rows, and this package on the workers' path.

    Whole texts can be long. The path serves local sessions that were started
    elsewhere; a cluster gets the package installed or by ``--py-files``.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, ROOT)))
    if int(spark.conf.get(BATCH_CONF)) > rows:
        spark.conf.set(BATCH_CONF, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int) -> Column:
    """Remainder 2 is held out; a row without id is learned from."""
    return F.coalesce(fold(doc_id, folds) == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a batch as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rows_out(schema: pa.Schema, columns: Iterable[list | np.ndarray | pa.Array]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def hash_table(seed: int = 7, places: int = 32) -> np.ndarray:
    """Random 64-bit values by place in a word and byte: a word's hash is their sum."""
    return np.random.default_rng(seed).integers(0, 2**63, (places, 256), dtype=np.uint64)


def word_hashes(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words between ASCII spaces, in order."""
    data = np.frombuffer(text, np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    at = np.flatnonzero(word)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    # every 32 bytes the table starts again, rotated, so that long words differ too
    value = table[place % len(table), data[at]] * (2 * (place // len(table)) + 1).astype(np.uint64)
    return np.add.reduceat(value, first), starts, ends


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece holds at most ``most`` bytes, or one row."""
    for batch in batches:
        rows, n = batch.num_rows, max(1, batch.nbytes // most)
        step = max(1, -(-rows // n))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest value, found by ever finer histograms of at most ``BINS`` bins."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while k > 0 and low is not None:
        inside = rows.filter(F.col(column).between(low, high))
        place = F.floor((F.col(column) - low) / ((high - low) or 1.0) * BINS)
        bins = (
            inside.groupBy(F.least(place, F.lit(BINS - 1)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for row in bins:
            if above + row.n >= k:
                break
            above += row.n
        else:
            return low
        low, high = row.low, row.high
        if low == high:
            return low
        if row.n <= BINS:
            last = rows.filter(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(BINS).collect()
            return last[k - above - 1][column]
    return None
