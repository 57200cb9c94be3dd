"""Nearest neighbours by permutations of pivots in inverted files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligatable.llm.common import rows_out, small_batches
from ligatable.session import cut_lineage

#: Sampled vectors that serve as pivots, and how many nearest ones represent a vector.
PIVOTS, PREFIX = 256, 64
#: One in so many vectors of a shard is reranked, in order of footrule distance.
RERANK_ONE_IN, RERANK_LEAST = 4, 256
#: Vectors of a shard, and queries of a block: what one task holds at a time.
SHARD_ROWS, BLOCK_QUERIES = 4096, 4096

INDEX = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("places", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part, one a ``vec_id``.

    Left out are rows without id and vectors that are null, empty, zero or hold a null
    or non-finite component, and all whose length is not the most frequent one. Where
    rows share an id, the smallest vector counts.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
        .filter("vec_id is not null and embedding is not null")
        .filter(~bad & F.exists("embedding", lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )
    length = good.groupBy(F.array_size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.filter(F.array_size("embedding") == (length.d if length else 0))


@dataclass
class Pivots:
    """Unit pivots with one more dimension, in which all vectors have the largest norm.

    With it, the order of inner products with a query is that of nearness.
    """

    points: np.ndarray
    norm: float

    def widened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1, keepdims=True), 0))
        return np.concatenate((x, rest), axis=1)

    def nearest(self, x: np.ndarray, prefix: int, query: bool = False) -> np.ndarray:
        """The numbers of the nearest pivots of each row, nearest first."""
        wide = np.concatenate((x, np.zeros((len(x), 1))), axis=1) if query else self.widened(x)
        return np.argsort(-(wide @ self.points.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, seed: int = 17) -> Pivots | None:
    """At most ``count`` different vectors, by hash of the id; these come to the driver.

    Ids are chosen first, so that no task gathers more vectors than are wanted.
    """
    order = F.xxhash64(F.lit(seed), "vec_id")
    chosen = F.broadcast(vectors.select("vec_id").orderBy(order, "vec_id").limit(2 * count))
    rows = sorted(vectors.join(chosen, "vec_id").withColumn("order", order).collect(), key=lambda r: (r.order, r.vec_id))
    if not rows:
        return None
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    norm = float(np.sqrt(vectors.agg(F.max(squares)).first()[0]))
    points = list(dict.fromkeys(tuple(r.embedding) for r in rows))[:count]
    pivots = Pivots(np.empty((0, 0)), norm)
    pivots.points = pivots.widened(np.array(points))
    return pivots


def build_index(vectors: DataFrame, pivots: Pivots, prefix: int = PREFIX, query: bool = False) -> DataFrame:
    """``(vec_id, vector, places)``: the vector's doubles, and its nearest pivots in order."""
    small_batches(vectors.sparkSession, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                places = pivots.nearest(x, prefix, query)
                yield rows_out(INDEX, [batch.column(0), [r.tobytes() for r in x], [r.tobytes() for r in places]])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vector binary, places binary")


class PostingFile:
    """A shard's vectors, posted under each of their pivots with the pivot's place."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, pivots: int):
        self.ids, self.vectors, self.prefix = ids, vectors, places.shape[1]
        order = np.argsort(places, axis=None, kind="stable")
        self.rows, self.at = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.cuts = np.searchsorted(places.ravel()[order], np.arange(pivots + 1)).tolist()

    def footrule(self, places: np.ndarray) -> np.ndarray:
        """Half the footrule distance of a query to each vector, up to a constant.

        A pivot that one of two permutations lacks stands behind its end. Only pivots
        that both have lower the sum: at ``i`` and ``j`` by ``prefix - max(i, j)``.
        """
        total = np.zeros(len(self.ids), np.int32)
        for i, p in enumerate(places.tolist()):
            post = slice(self.cuts[p], self.cuts[p + 1])
            total[self.rows[post]] += np.maximum(self.at[post], i) - self.prefix
        return total

    def search(self, query_id: int, query: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` largest inner products among the vectors nearest by footrule."""
        n = len(self.ids)
        take = min(n, max(RERANK_LEAST, k + 1, n // RERANK_ONE_IN))
        distance = self.footrule(places)
        # all that tie at the cut are in, so equal vectors are never told apart
        chosen = np.flatnonzero(distance <= np.partition(distance, take - 1)[take - 1])
        chosen = chosen[self.ids[chosen] != query_id]
        scores = self.vectors[chosen] @ query
        best = np.lexsort((self.ids[chosen], -scores))[:k]
        return self.ids[chosen[best]], scores[best]


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _searcher(pivots: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if shard.num_rows and queries.num_rows:
            places = np.frombuffer(b"".join(shard["places"].to_pylist()), np.int16).reshape(shard.num_rows, -1)
            posted = PostingFile(shard["vec_id"].to_numpy(), _doubles(shard["vector"]), places, pivots)
            vectors = _doubles(queries["vector"])
            for i, (q, places_) in enumerate(zip(queries["vec_id"].to_pylist(), queries["places"].to_pylist())):
                ids, scores = posted.search(q, vectors[i], np.frombuffer(places_, np.int16), k)
                found.append((q, ids.tolist(), scores.tolist()))
        return pa.Table.from_batches([rows_out(FOUND, [[f[c] for f in found] for c in range(3)])])

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, count: int = PIVOTS, prefix: int = PREFIX
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query.

    Both tables have ``vec_id, embedding``; see ``usable`` for the rows that take part. A
    vector is the order of its ``prefix`` nearest among ``count`` pivots, which are a
    bounded sample; every vector is indexed. Vectors are dealt by hash to shards of
    about ``SHARD_ROWS``; a shard posts its vectors in one inverted file a pivot.
    Queries go to all shards in blocks, collect the footrule distances of what they
    meet in their pivots' files, and the nearest quarter is reranked in double precision.
    A shard sends ``k`` rows a query at most. Ties go to the smaller ``vec_id``. Queries
    never find themselves. With ``k`` candidates or fewer, all are returned.
    """
    base = cut_lineage(usable(vectors))
    pivots = choose_pivots(base, count)
    wanted = usable(queries)
    if pivots is None:
        return base.selectExpr("vec_id query_id", "0 rank", "vec_id", "0D score").limit(0)
    prefix = min(prefix, len(pivots.points))
    length = pivots.points.shape[1] - 1
    wanted = cut_lineage(wanted.filter(F.array_size("embedding") == length))
    shards = max(1, -(-base.count() // SHARD_ROWS))
    blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = build_index(base, pivots, prefix).withColumn("shard", dealt(shards).cast("int")).withColumn("block", every(blocks))
    right = (
        build_index(wanted, pivots, prefix, query=True)
        .withColumn("block", dealt(blocks).cast("int"))
        .withColumn("shard", every(shards))
    )
    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(_searcher(len(pivots.points), k), "query_id long, ids array<long>, scores array<double>")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
