"""Joins that survive one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligatable.session import cut_lineage

ROWS_PER_TASK = 1_000_000


def one_per(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key: the smallest, column by column in the given order."""
    kept = columns or tuple(c for c in table.columns if c != key)
    smallest = F.min(F.struct(*kept)).alias("_one")
    return table.groupBy(key).agg(smallest).select(key, *(F.col(f"_one.{c}").alias(c) for c in kept))


def key_salts(counts: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(key, _salts)`` of the keys in ``(key, rows)`` that have more rows than a task should get."""
    salts = F.ceil(F.col("rows") / rows_per_task).cast("int")
    return counts.filter(F.col(key).isNotNull() & (F.col("rows") > rows_per_task)).select(key, salts.alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join where ``left`` may have hot keys and ``right`` has few rows per key.

    A key with more than ``rows_per_task`` left rows is spread over as many salts as it
    needs, and its right rows are repeated once per salt; others keep one. The table of
    salts has fewer than ``rows / rows_per_task`` rows, so it is broadcast and ``left``
    moves once; there is no limit to the number of hot keys. Null keys match nothing and are spread too, where
    the join keeps them. The result is that of the plain join for ``inner``, ``left``,
    ``left_semi`` and ``left_anti``. The salt is a hash of the left row, so a retried
    task repeats it; left rows are expected to differ from each other.

    Give ``counts`` (left rows per key) where the caller has them. Without, ``left`` is
    written once and counted from the written copy.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted {how} join would repeat right rows")
    if counts is None:
        left = cut_lineage(left)
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    salts = key_salts(counts, key, rows_per_task)
    # null keys, which have no count, go to as many places as there are partitions
    spread = F.when(F.col(key).isNull(), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = F.coalesce(F.col("_salts"), spread, F.lit(1))
    salt = F.pmod(F.xxhash64(*left.columns), wanted).cast("int")
    salted_left = left.join(F.broadcast(salts), key, "left").withColumn("_salt", salt).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    salted_right = right.join(F.broadcast(salts), key, "left").withColumn("_salt", every).drop("_salts")
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
