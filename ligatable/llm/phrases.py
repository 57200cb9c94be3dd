"""Phrase collocations by set-oriented mining over sorted occurrence relations."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligatable.llm.common import LOWER, pieces, small_batches, utf8
from ligatable.operators.skew import salted_join
from ligatable.session import cut_lineage, drop_staged, shuffles_go, staging_path

# Bytes that end a piece; all become the mark, which no word can hold.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b"."
#: A-Z lower-cased, ends of pieces as the mark, tabs as spaces.
FOLDED = bytes(MARK[0] if b in PIECE_ENDS else 0x20 if b == 0x09 else LOWER[b] for b in range(256))
MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Bytes of text that a block of the relation holds before it is closed at the end of a piece.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose words are held as Python objects at once.
CHUNK_BYTES = 1 << 20
#: A block's number is that of the task, shifted, plus its place; a group's code is the block's, shifted, plus its place.
BLOCK_BITS, GROUP_BITS = 12, 31
#: How written relations are compressed.
STAGED = "zstd"
#: Rows of an Arrow batch of groups.
GROUP_ROWS = 1 << 18

#: An occurrence row holds a block's sorted places and groups; a group row one group of a block and its count.
RELATION = pa.schema(
    [
        ("block", pa.int64()),
        ("places", pa.binary()),
        ("groups", pa.binary()),
        ("idx", pa.int32()),
        ("n", pa.int64()),
        ("lang", pa.string()),
        ("word", pa.string()),
        ("a", pa.int64()),
        ("b", pa.int64()),
    ]
)
DDL = "block long, places binary, groups binary, idx int, n long, lang string, word string, a long, b long"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint32)


def occurrence_batch(block: int, places: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """One row: places ascending, as steps from one to the next, and the group at each."""
    columns = {"block": [block], "places": [_packed(np.diff(places, prepend=0))], "groups": [_packed(groups)]}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None]), f.type) for f in RELATION], schema=RELATION)


def group_batches(block: int, counts: np.ndarray, **keys: list | np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each group of a block that occurs."""
    for at in range(0, len(counts), GROUP_ROWS):
        n = counts[at : at + GROUP_ROWS]
        columns = {"block": np.full(len(n), block), "idx": np.arange(at, at + len(n)), "n": n}
        columns |= {k: v[at : at + GROUP_ROWS] for k, v in keys.items()}
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(n), f.type)
                if f.name not in columns
                else pa.array(columns[f.name], pa.binary()).cast(pa.string())
                if f.type == pa.string()
                else pa.array(columns[f.name], f.type)
                for f in RELATION
            ],
            schema=RELATION,
        )


def _chunks(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of bounded size, cut at spaces and marks only."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        end = max(text.rfind(b" ", at, at + CHUNK_BYTES), text.rfind(MARK, at, at + CHUNK_BYTES)) + 1
        if not end:
            # one word longer than a chunk
            ends = [i + 1 for i in (text.find(b" ", at), text.find(MARK, at)) if i >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


class Block:
    """Words of some texts in order, numbered by language; marks keep pieces apart."""

    def __init__(self) -> None:
        self.size = 0
        self.parts: list[np.ndarray] = []
        number = count()
        self.ids: dict[bytes, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))
        self.marks: set[int] = set()

    def add(self, lang: bytes, chunk: bytes) -> None:
        ids = self.ids[lang]
        found = chunk.replace(MARK, b" . ").split()
        self.parts.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
        self.size += len(chunk)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        stream = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        keys = sorted((i, lang, word) for lang, ids in self.ids.items() for word, i in ids.items())
        is_word = np.array([word != MARK for _, _, word in keys], bool)
        places = np.flatnonzero(is_word[stream]) if len(keys) else np.empty(0, np.int64)
        if not len(places):
            return
        number = np.cumsum(is_word) - 1
        groups = number[stream[places]]
        kept = [k for k in keys if k[2] != MARK]
        yield occurrence_batch(block, places, groups)
        yield from group_batches(block, np.bincount(groups), lang=[k[1] for k in kept], word=[k[2] for k in kept])


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``BLOCK_BYTES`` and one piece, from the rows of a task."""
    task, done, block = TaskContext.get().partitionId(), 0, Block()

    def close() -> Iterator[pa.RecordBatch]:
        if done >> BLOCK_BITS:
            raise ValueError("a task has more text than its numbers of blocks can tell apart: use more partitions")
        yield from block.rows((task << BLOCK_BITS) + done)

    for piece in pieces(batches):
        for lang, text in zip(utf8(piece.column(0)), utf8(piece.column(1))):
            for chunk in _chunks(text.translate(FOLDED) + MARK):
                block.add(lang, chunk)
                if block.size >= BLOCK_BYTES and chunk.endswith(MARK):
                    yield from close()
                    done, block = done + 1, Block()
    yield from close()


def extended(places: np.ndarray, groups: np.ndarray, idx: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted relation of the next length from one whose frequent groups are ``idx``, numbered ``ids``.

    The semi-join leaves the rows of frequent groups; the merge-join pairs a row with that at
    the next place, which is in the same piece. Returns places, groups, and the numbers of the
    first and the second part of each group and its count.
    """
    if not len(idx):
        return (np.empty(0, np.int64),) * 5
    number = np.full(int(groups.max(initial=0)) + 1, -1, np.int32)
    number[idx] = np.arange(len(idx))
    local = number[groups]
    frequent = local >= 0
    places, local = places[frequent], local[frequent]
    next_to = np.flatnonzero(np.diff(places) == 1)
    pairs = local[next_to] * np.int64(len(idx)) + local[next_to + 1]
    pairs, found, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    return places[next_to], found, ids[pairs // len(idx)], ids[pairs % len(idx)], counts


def _extend(key: tuple, occurrences: pa.Table, frequent: pa.Table) -> pa.Table:
    """The next relation of one block; several pieces of a block do not occur."""
    batches: list[pa.RecordBatch] = []
    for row in occurrences.to_pylist():
        places, groups = np.cumsum(_unpacked(row["places"]), dtype=np.int64), _unpacked(row["groups"])
        idx, ids = (frequent.column(c).to_numpy() for c in ("idx", "id"))
        places, groups, a, b, counts = extended(places, groups, idx, ids)
        if len(places):
            batches.append(occurrence_batch(row["block"], places, groups))
            batches += group_batches(row["block"], counts, a=a, b=b)
    return pa.Table.from_batches(batches, schema=RELATION)


def _frequent(relation: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """The group rows of groups with ``min_count`` occurrences, with their ``f`` and ``id``.

    A block has one row per group, so groups are counted, and found again in their blocks, with
    one shuffle; a group's rows are at most as many as blocks. A group's first row names it.
    """
    of_group = Window.partitionBy(*keys)
    code = F.shiftleft("block", GROUP_BITS) + F.col("idx")
    counted = relation.filter("places is null").select("n", *keys, code.alias("code"))
    # rows of a group lie in one partition, and all that is read later is this written copy
    named = (
        counted.withColumn("f", F.sum("n").over(of_group))
        .filter(F.col("f") >= min_count)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("id", F.min("row").over(of_group))
    )
    block = F.shiftright("code", GROUP_BITS).alias("block")
    idx = F.col("code").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).alias("idx")
    return cut_lineage(named.select(block, idx, "id", (F.col("row") == F.col("id")).alias("is_first"), "f", *keys))


def _words(frequent: DataFrame) -> DataFrame:
    """Phrases of one word; ``firsts`` and ``lasts`` hold the counts of their parts by length."""
    one = frequent.filter("is_first")
    return one.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f").withColumns(
        {"firsts": F.array("f"), "lasts": F.array("f"), "a": F.lit(None).cast("long"), "b": F.lit(None).cast("long")}
    )


def _longer(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases one word longer, from those of their first and their last words."""
    first = shorter.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("start"), F.col("firsts").alias("start_firsts"))
    second = shorter.select(F.col("id").alias("b"), "last", F.col("lasts").alias("end_lasts"))
    joined = frequent.filter("is_first").select("id", "a", "b", "f").join(first, "a").join(second, "b")
    return joined.select(
        "id",
        "lang",
        F.concat_ws(" ", "start", "last").alias("phrase"),
        "last",
        "f",
        F.array_append("start_firsts", F.col("f")).alias("firsts"),
        F.array_append("end_lasts", F.col("f")).alias("lasts"),
        "a",
        "b",
    )


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of ``docs (text, lang)`` by length, and ``(lang, n)``, the words of each language.

    Each length has a written relation of sorted occurrences, in blocks of text. Its groups are
    counted; their blocks get the numbers of the frequent ones, drop the others, and join
    neighbouring occurrences to the next relation. Nothing is broadcast. What a step shuffled goes
    when the step is written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    # each step is run once and written
    with shuffles_go(spark):
        path = staging_path(spark, "occurrences")
        texts.mapInArrow(_tokenise, DDL).write.parquet(path, compression=STAGED)
        relation = spark.read.schema(DDL).parquet(path)
        sizes = cut_lineage(relation.filter("places is null").groupBy("lang").agg(F.sum("n").alias("n")))
        frequent = _frequent(relation, ["lang", "word"], min_count)
        phrases = [cut_lineage(_words(frequent))]
        for _ in range(max_words - 1):
            occurrences = relation.filter("places is not null").select("block", "places", "groups")
            left = occurrences.groupBy("block").cogroup(frequent.select("block", "idx", "id").groupBy("block"))
            longer = staging_path(spark, "occurrences")
            left.applyInArrow(_extend, DDL).write.parquet(longer, compression=STAGED)
            drop_staged(spark, path)
            path, relation = longer, spark.read.schema(DDL).parquet(longer)
            frequent = _frequent(relation, ["a", "b"], min_count)
            phrases.append(cut_lineage(_longer(frequent, phrases[-1])))
        drop_staged(spark, path)
    return phrases, sizes


def _wide(c: str | Column) -> Column:
    return F.col(c).cast("decimal(16,0)") if isinstance(c, str) else c.cast("decimal(16,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of each language.

    Texts are lower-cased in A-Z and split at ``.,;:!?`` and line ends (LF, VT, FF, CR) into
    pieces, and these at spaces and tabs into words. Null texts have none; a null language is
    ``und``. Phrases of 2 to ``max_words`` words that occur ``min_count`` times within pieces,
    overlaps counted, are candidates. A cut scores ``floor(1000 * a * n / (l * r))`` from the
    counts of the phrase, all words, and both parts; the lowest counts, ties to the earlier cut.
    Candidates inside a longer one with the same count go. Ties of scores go by count, then by
    phrase in byte order. Rows are what they hold: repeated rows and rows without id count.
    Other columns are not read. No documents give no rows.

    Numbers up to 10^16 are exact. Counts fall with length, so where a longer candidate has the
    same count, so have all between: the two parts one word shorter tell what goes.
    """
    phrases, sizes = mine(docs, min_count, max_words)
    # a number names a group among those of its length
    candidates = cut_lineage(reduce(DataFrame.unionByName, phrases[1:]).withColumn("length", F.size("firsts")))
    whole = [
        candidates.filter(F.col("f") == F.element_at(side, -2)).select((F.col("length") - 1).alias("length"), F.col(part).alias("id"))
        for side, part in (("firsts", "a"), ("lasts", "b"))
    ]
    left = candidates.join(whole[0].unionByName(whole[1]).distinct(), ["length", "id"], "left_anti")
    per_lang = left.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    sized = salted_join(left, sizes, "lang", counts=per_lang)
    dividend = F.lit(1000).cast("decimal(4,0)") * _wide("f") * _wide("n")

    def cut(k: Column) -> Column:
        parts = F.element_at("firsts", k), F.element_at("lasts", F.col("length") - k)
        score = F.call_function("div", dividend, _wide(parts[0]) * _wide(parts[1]))
        return F.struct(score.alias("score"), k.alias("k"), parts[0].alias("l"), parts[1].alias("r"))

    lowest = F.array_min(F.transform(F.sequence(F.lit(1), F.col("length") - 1), cut))
    scored = sized.withColumn("cut", lowest).select(
        "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").alias("score")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
