"""Alignment of two tokenizers, with corpus-wide pair counts by external spilling and merging."""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligatable.llm.common import pieces, small_batches
from ligatable.session import cut_lineage, drop_staged, staging_path

#: Between a character that is no white space and a space neither tokenizer has a token.
EDGE = re.compile(r"(?<=\S)(?= )")
#: Characters of text that are taken apart at once, and of a block of documents.
STEP_CHARS, BLOCK_CHARS = 1 << 20, 16 << 20
#: Chunks that a task remembers; longer chunks are not kept.
KNOWN_CHUNKS, KNOWN_CHARS = 400_000, 64
#: Ranges of ids of the first tokenizer: each is counted by itself.
RANGES = 256
#: Runs that are merged at once.
FAN_IN = 64
#: Records of a run that are held at once.
RUN_RECORDS = 4096
RECORD = np.dtype([("step", "<u8"), ("n", "<u8")])
BLOCK_BITS = 12

#: A document row, a block's pair-document records, or the run of a range of its pairs.
ALIGNED = pa.schema(
    [
        ("block", pa.int64()),
        ("place", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("records", pa.binary()),
        ("range", pa.int32()),
        ("run", pa.binary()),
    ]
)
COUNTS = "n_a long, n_b long, n_groups long, n_links long"
DDL = f"block long, place long, doc_id long, {COUNTS}, groups_sha256 string, records binary, range int, run binary"
RUN_DDL = "range int, block long, run binary"
RUNS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("run", pa.binary())])
RESULT = f"doc_id long, {COUNTS}, n_best long, count_sum long, groups_sha256 string"
RESULTS = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string())]
)


def byte_signs() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies, by their rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both libraries, the bytes of their tokens, and whether chunks may be encoded apart."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        sign, names = byte_signs(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(sign[c] for c in name) if all(c in sign for c in name) else name.encode()
        pieces_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_b)
        ]
        with open(path_a, encoding="utf-8") as file:
            rule = json.load(file)
        splits = rule["pre_tokenizer"] or {}
        # the first splits before a space that follows anything else; the second has no piece across one
        self.apart = (
            rule["normalizer"] is None
            and splits.get("type") == "ByteLevel"
            and splits.get("use_regex", True)
            and not splits.get("add_prefix_space")
            and not any(re.search("[^▁]▁", p) for p in pieces_b)
        )
        self.space = self.b.piece_to_id("▁")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks that start with a space; the second tokenizer puts it there itself."""
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return a, [ids if len(c) > 1 else [self.space] for c, ids in zip(chunks, b)]


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    """Read once by each Python process."""
    return Tokenizers(path_a, path_b)


def steps(text: str, apart: bool) -> Iterator[str]:
    """A text in parts of about ``STEP_CHARS``, cut where chunks may be cut."""
    at = 0
    while apart and len(text) - at > STEP_CHARS:
        edge = EDGE.search(text, at + STEP_CHARS)
        if not edge:
            break
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


class Chunks:
    """What the alignment of distinct chunks gives, computed once for many of them.

    Both tokenizers end a token at each chunk's end, so counts add up, links are those of the
    chunks, and the groups of a text are the chunks' in order.
    """

    def __init__(self, tools: Tokenizers):
        self.tools = tools
        self.width = len(tools.b_bytes)
        self.sizes_a = np.array([len(x) for x in tools.a_bytes], np.int64)
        self.sizes_b = np.array([len(x) for x in tools.b_bytes], np.int64)
        numbers = range(max(len(tools.a_bytes), self.width))
        self.signs = [b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in numbers]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.counts = np.empty((0, 4), np.int64)
        self.links = np.empty(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks; one that a tokenizer does not give back has ``None`` as its groups."""
        ids_a, ids_b = self.tools.encode(chunks)
        a_bytes, b_bytes = self.tools.a_bytes.__getitem__, self.tools.b_bytes.__getitem__
        raw = [c.encode() for c in chunks]
        same = [b"".join(map(a_bytes, a)) == r == b"".join(map(b_bytes, b)) for a, b, r in zip(ids_a, ids_b, raw)]
        n = len(chunks)
        a = np.array([i for ids, ok in zip(ids_a, same) if ok for i in ids], np.int64)
        b = np.array([i for ids, ok in zip(ids_b, same) if ok for i in ids], np.int64)
        n_a = np.array([len(x) * ok for x, ok in zip(ids_a, same)], np.int64)
        n_b = np.array([len(x) * ok for x, ok in zip(ids_b, same)], np.int64)
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        total = int(end_a[-1]) if len(a) else 0
        mark = np.zeros(total + 1, np.uint8)
        mark[end_a] |= 1
        mark[end_b] |= 2
        # a link ends where a token of either ends; a group where both do
        at = np.flatnonzero(mark)
        kind = mark[at]
        of_a = np.cumsum(kind & 1, dtype=np.int64) - (kind & 1)
        of_b = np.cumsum(kind >> 1, dtype=np.int64) - (kind >> 1)
        chunk_end = np.cumsum([len(r) * ok for r, ok in zip(raw, same)])
        of_chunk = np.searchsorted(chunk_end, at, "left")
        both = kind == 3
        n_links = np.bincount(of_chunk, minlength=n)
        n_groups = np.bincount(of_chunk[both], minlength=n)
        self.groups += self._texts(a, b, of_a[both], of_b[both], n_groups, same)
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, n_groups, n_links), 1)))
        self.links = np.concatenate((self.links, a[of_a] * self.width + b[of_b]))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(n_links)))
        start = len(self.number)
        self.number.update((c, start + i) for i, c in enumerate(chunks))

    def _texts(
        self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_groups: np.ndarray, same: list[bool]
    ) -> list[bytes | None]:
        """The groups of each chunk as text, from the last tokens of all groups."""
        size = len(self.signs) // 3
        sign = np.empty(len(a) + len(b), np.int64)
        group_a = np.searchsorted(last_a, np.arange(len(a)), "left")
        group_b = np.searchsorted(last_b, np.arange(len(b)), "left")
        before_b = np.concatenate(([0], last_b + 1))
        place_a = np.arange(len(a)) + before_b[group_a] if len(a) else group_a
        place_b = np.arange(len(b)) + last_a[group_b] + 1 if len(b) else group_b
        sign[place_a] = a
        sign[place_b] = b
        sign[place_a[last_a]] += size
        sign[place_b[last_b]] += 2 * size
        texts = list(map(self.signs.__getitem__, sign.tolist()))
        # a chunk's tokens end with the last token of its last group
        upto = np.concatenate(([0], np.cumsum(n_groups)))
        ends = np.concatenate(([0], place_b[last_b] + 1))[upto].tolist()
        return [b"".join(texts[x:y]) if ok else None for x, y, ok in zip(ends, ends[1:], same)]

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text; those not seen before are aligned first."""
        found = [EDGE.split(t) if self.tools.apart else [t] for t in texts]
        if len(self.number) > KNOWN_CHUNKS:
            self.forget()
        new = {c for chunks in found for c in chunks if c not in self.number}
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.number.__getitem__, c), np.int64, len(c)) for c in found]


class Block:
    """Documents in order, with their pair-document records."""

    def __init__(self) -> None:
        self.chars = 0
        self.ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[hashlib._Hash | None] = []
        self.tails: list[bytes] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def open(self, doc_id: int | None) -> int:
        self.ids.append(doc_id)
        self.counts.append(np.zeros(4, np.int64))
        self.hashes.append(hashlib.sha256())
        self.tails.append(b"")
        return len(self.ids) - 1

    def add(self, known: Chunks, docs: list[int], texts: list[str]) -> None:
        """Parts of texts and the documents that they belong to, in order."""
        found = known.numbers(texts)
        self.chars += sum(map(len, texts))
        for doc, numbers in zip(docs, found):
            groups = [known.groups[i] for i in numbers.tolist()]
            if self.hashes[doc] is None or None in groups:
                self.hashes[doc] = None
                continue
            # the sign after a text's last group is left off
            text = self.tails[doc] + b"".join(groups)
            self.hashes[doc].update(text[:-1])
            self.tails[doc] = text[-1:]
            self.counts[doc] += known.counts[numbers].sum(0)
        every = np.concatenate(found)
        sizes = known.counts[every, 3]
        start = np.repeat(known.first[every] - (np.cumsum(sizes) - sizes), sizes)
        links = known.links[start + np.arange(len(start))]
        of_doc = np.repeat(np.repeat(docs, [len(x) for x in found]), sizes)
        span = known.width * len(known.sizes_a)
        keys, n = np.unique((of_doc - docs[0]) * span + links, return_counts=True)
        self.parts.append((keys // span + docs[0], keys % span, n))

    def rows(self, block: int, known: Chunks, ranges: int) -> Iterator[pa.RecordBatch]:
        """Documents; records by document; and runs of distinct pairs with their documents, in order."""
        if not self.ids:
            return
        good = np.array([h is not None for h in self.hashes])
        doc, pair, n = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, np.int64) for i in range(3))
        doc, pair, n = _summed(doc, pair, n, good)
        counts = np.array(self.counts) * good[:, None]
        sha = [h.hexdigest() if h and c[0] else "" for h, c in zip(self.hashes, counts)]
        columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts.T)) | {"groups_sha256": sha}
        yield _rows(block, len(sha), place=np.arange(len(sha)), doc_id=self.ids, **columns)
        pairs, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
        sizes = np.bincount(doc, minlength=len(sha))
        yield _rows(block, 1, records=[_packed(np.concatenate(([len(sha)], sizes, at, n)))])
        part = pairs // known.width * ranges // len(known.sizes_a)
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        full = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
        if full:
            runs = [written_run(zip(pairs[x:y].tolist(), docs[x:y].tolist())) for x, y in ((cuts[r], cuts[r + 1]) for r in full)]
            yield _rows(block, len(full), range=full, run=runs)


def _summed(doc: np.ndarray, pair: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, ...]:
    """Records of good documents, one for each document and pair, in this order."""
    kept = good[doc] if len(doc) else np.empty(0, bool)
    doc, pair, n = doc[kept], pair[kept], n[kept]
    order = np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
    return doc[new], pair[new], np.add.reduceat(n, new) if len(new) else n


def _rows(block: int, n: int, **columns: Iterable) -> pa.RecordBatch:
    columns["block"] = np.full(n, block)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ALIGNED], schema=ALIGNED
    )


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint32).astype(np.int64)


def written_run(records: Iterable[tuple[int, int]]) -> bytes:
    """A zstd run of ``(pair, documents)`` in ascending order; pairs as steps from the one before."""
    out, last, held = io.BytesIO(), 0, []
    with zstandard.ZstdCompressor(level=1).stream_writer(out, closefd=False) as stream:

        def flush() -> None:
            stream.write(np.array(held, RECORD).tobytes())
            held.clear()

        for pair, n in records:
            held.append((pair - last, n))
            last = pair
            if len(held) == RUN_RECORDS:
                flush()
        flush()
    return out.getvalue()


def read_run(run: bytes) -> Iterator[np.ndarray]:
    """The records of a run, some at a time, as two columns."""
    last, size = 0, RUN_RECORDS * RECORD.itemsize
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(run)) as stream:
        while data := stream.read(size):
            while len(data) % RECORD.itemsize:
                data += stream.read(RECORD.itemsize - len(data) % RECORD.itemsize)
            held = np.frombuffer(data, RECORD)
            pairs = last + np.cumsum(held["step"].astype(np.int64))
            last = int(pairs[-1])
            yield np.stack((pairs, held["n"].astype(np.int64)), 1)


def merged(runs: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """The pairs of all runs in order, each with its documents, by a heap over the runs."""
    streams = [(tuple(r) for part in read_run(run) for r in part.tolist()) for run in runs]
    for pair, same in groupby(heapq.merge(*streams), itemgetter(0)):
        yield pair, sum(n for _, n in same)


def _merge(key: tuple, runs: pa.Table) -> pa.Table:
    """One run from those of a range that fall to one part."""
    run = written_run(merged(runs.column("run").to_pylist()))
    return pa.Table.from_pydict({"range": [key[0].as_py()], "block": [key[1].as_py()], "run": [run]}, RUNS)


def _tally(width: int):
    def run(key: tuple, runs: pa.Table) -> pa.Table:
        """The last merge: side by side, so a first id's highest count is known where the next begins."""

        def marked() -> Iterator[tuple[int, int]]:
            for _, pairs in groupby(merged(runs.column("run").to_pylist()), lambda r: r[0] // width):
                of_one = list(pairs)
                most = max(n for _, n in of_one)
                yield from ((pair, 2 * n + (n == most)) for pair, n in of_one)

        return pa.Table.from_pydict({"range": [key[0].as_py()], "block": [0], "run": [written_run(marked())]}, RUNS)

    return run


def _give_back(key: tuple, runs: pa.Table, tally: pa.Table) -> pa.Table:
    """To each block the counts of its pairs of a range, in their order."""
    total = np.concatenate(list(read_run(tally.column("run")[0].as_py())))
    back = []
    for row in runs.to_pylist():
        pairs = np.concatenate([part[:, 0] for part in read_run(row["run"])])
        given = total[np.searchsorted(total[:, 0], pairs), 1]
        back.append({"range": row["range"], "block": row["block"], "run": zstandard.compress(given.tobytes(), 1)})
    return pa.Table.from_pylist(back, RUNS)


def _sum_up(key: tuple, aligned: pa.Table, given: pa.Table) -> pa.Table:
    """The documents of one block with what their links count."""
    records = aligned.filter(pc.is_valid(aligned.column("records"))).column("records")
    docs = aligned.filter(pc.is_valid(aligned.column("place"))).sort_by("place")
    if not docs.num_rows:
        return pa.Table.from_pylist([], RESULTS)
    gifts = [np.frombuffer(zstandard.decompress(r), np.int64) for r in given.sort_by("range").column("run").to_pylist()]
    value = np.concatenate(gifts) if gifts else np.empty(0, np.int64)
    data = _unpacked(records[0].as_py())
    sizes, rest = data[1 : data[0] + 1], data[data[0] + 1 :]
    at, n = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    ends, sums = np.cumsum(sizes), []
    for each in ((value[at] & 1) * n, (value[at] >> 1) * n):
        # whole numbers: running totals instead of weights, which would be doubles
        upto = np.concatenate(([0], np.cumsum(each)))
        sums.append(upto[ends] - upto[ends - sizes])
    columns = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.Table.from_arrays(
        [columns[f.name] if f.name in columns else docs.column(f.name).combine_chunks() for f in RESULTS], schema=RESULTS
    )


def _align(path_a: str, path_b: str, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chunks(tokenizers_of(path_a, path_b))
        task, done, block = TaskContext.get().partitionId(), 0, Block()
        docs: list[int] = []
        texts: list[str] = []

        def take() -> None:
            if texts:
                block.add(known, docs, texts)
                docs.clear()
                texts.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if done >> BLOCK_BITS:
                raise ValueError("a task has more text than its numbers of blocks can tell apart: use more partitions")
            yield from block.rows((task << BLOCK_BITS) + done, known, ranges)

        for piece in pieces(batches):
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                doc = block.open(doc_id)
                for part in steps(" " + text, known.tools.apart) if text else ():
                    docs.append(doc)
                    texts.append(part)
                    if sum(map(len, texts)) >= STEP_CHARS:
                        take()
                if block.chars >= BLOCK_CHARS:
                    take()
                    yield from close()
                    done, block = done + 1, Block()
        take()
        yield from close()

    return run


def aligned_documents(
    docs: DataFrame, path_a: str, path_b: str, ranges: int = RANGES, fan_in: int = FAN_IN
) -> DataFrame:
    """How the tokens of two tokenizers lie over each text of ``docs (doc_id, text)``.

    ``path_a`` names a byte-level file of ``tokenizers``, which encodes a space and the text;
    ``path_b`` a ``sentencepiece`` model, which adds the space. No special tokens are added, and
    their strings are plain text. Texts that are null or empty, or that a tokenizer does not give
    back byte by byte, have no tokens: zeros and an empty digest. Returns ``doc_id``, ``n_a``
    and ``n_b`` tokens, ``n_groups`` between places where tokens of both end, ``n_links``
    between tokens that share bytes, ``n_best`` (links whose pair of ids stands in as many
    documents as the best of its first id, ties counted), ``count_sum`` (those numbers of
    documents, over all links) and ``groups_sha256``. A row is a document: repeated rows and rows
    without id count and come back each. Other columns are not read. No documents give no rows.

    Pair-document records stay in blocks of documents. Each block writes its distinct pairs,
    with the number of its documents, as sorted zstd runs, one for each range of first ids. Runs
    of a range meet, at most about ``fan_in`` at once and in rounds, in a heap merge that counts
    pairs; their order puts the pairs of a first id together, which gives its highest count.
    What a block's pairs count goes back to it and is summed by document. A pair has at most one
    record a block, however frequent it is. The files must have the same place on all executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = len(tokenizers_of(path_a, path_b).b_bytes)
    path = staging_path(spark, "aligned")
    picked = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    picked.mapInArrow(_align(path_a, path_b, ranges), DDL).write.parquet(path)
    aligned = spark.read.schema(DDL).parquet(path)
    runs = aligned.filter("run is not null").select("range", "block", "run")
    blocks = aligned.filter("records is not null").count()

    def part(parts: int):
        return F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part")

    rounds, left, before = runs, blocks, None
    while left > fan_in:
        left = -(-left // fan_in)
        step = rounds.select("range", part(left), "run").groupBy("range", "part").applyInArrow(_merge, RUN_DDL)
        after = staging_path(spark, "runs")
        step.write.parquet(after)
        if before:
            drop_staged(spark, before)
        before, rounds = after, spark.read.schema(RUN_DDL).parquet(after)
    tally = cut_lineage(rounds.groupBy("range").applyInArrow(_tally(width), RUN_DDL).select("range", "run"))
    if before:
        drop_staged(spark, before)
    parts = max(1, -(-blocks // fan_in))
    every = tally.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    dealt = runs.withColumn("part", part(parts).cast("long"))
    given = dealt.groupBy("range", "part").cogroup(every.groupBy("range", "part")).applyInArrow(_give_back, RUN_DDL)
    of_block = aligned.filter("run is null").drop("range", "run").groupBy("block")
    return of_block.cogroup(given.groupBy("block")).applyInArrow(_sum_up, RESULT)
