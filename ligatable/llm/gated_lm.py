"""Log-likelihood of whole documents under a gated recurrent language model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ligatable.llm import gru
from ligatable.llm.common import LOWER, held_out, kth_largest, pieces, rows_out, small_batches, utf8
from ligatable.session import cut_lineage, drop_staged, staging_path

HIDDEN = 16
#: Words with outputs of their own, in classes of 64 by rank; all others are in rare classes.
MODELLED, IN_CLASS, RARE_CLASSES = 2048, 64, 32
#: Words whose counts travel with the tasks; counts of all others are joined.
LISTED = 150_000
#: Training tokens of a copy of the model, and rounds after which copies are averaged.
COPY_TOKENS, ROUNDS = 1 << 20, 4
#: Tokens after which a longer document is dealt to another copy.
SEGMENT = 1 << 16
#: Rate of the first round; a round's is this by its number.
RATE = 0.01
#: Steps that gradients go back; the state goes on.
WINDOW = 32
#: Windows that a step of training reads side by side at most; a pass takes eight steps or more.
LANES = 128
#: Tokens whose class probabilities are computed at a time, to stay in the cache.
CHUNK = 2048
#: The end of a document; no word can be this.
END = b"\n"
#: Distinct words that a task holds before it sends their counts on.
HELD = 200_000

WORD_ROWS = pa.schema([("word", pa.binary()), ("rare_class", pa.int32()), ("n", pa.int64())])
PART_ROWS = pa.schema(
    [
        ("rid", pa.int64()),
        ("doc_id", pa.int64()),
        ("word", pa.binary()),
        ("n", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("log_counts", pa.float64()),
        ("score", pa.float64()),
    ]
)
PART_DDL = (
    "rid long, doc_id long, word binary, n long, n_tokens long, n_known long, log_counts double, score double"
)
SEGMENT_ROWS = pa.schema([("key", pa.int64()), ("segment", pa.int32()), ("codes", pa.binary())])
WEIGHT_ROWS = pa.schema([("weights", pa.binary()), ("tokens", pa.float64())])


def tokens(text: bytes) -> list[bytes]:
    found = text.translate(LOWER).split()
    found.append(END)
    return found


def rare_class(word: bytes) -> int:
    """The class of a word without outputs of its own, by its last letters."""
    return crc32(word[-3:]) % RARE_CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, rare_class, n)`` over all rows of ``texts (text)``, ends included.

    A task counts before it sends, and sends what it holds once that is much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for piece in pieces(batches, 2 << 20):
            for text in utf8(piece.column(0)):
                held.update(tokens(text))
            if len(held) > HELD:
                yield rows_out(WORD_ROWS, [list(held), list(map(rare_class, held)), list(held.values())])
                held.clear()
        yield rows_out(WORD_ROWS, [list(held), list(map(rare_class, held)), list(held.values())])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(run, "word binary, rare_class int, n long")
    return rows.groupBy("word").agg(F.min("rare_class").alias("rare_class"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What a task knows of the counts: listed words and totals.

    ``codes`` numbers listed words: below ``size`` a word with outputs of its own (0 is
    the end), above that a rare class. ``counts`` are theirs in the training documents.
    """

    words: bytes
    codes: np.ndarray
    counts: np.ndarray
    size: int
    n: int
    distinct: int
    rare_log: np.ndarray

    @property
    def classes(self) -> int:
        return -(-self.size // IN_CLASS)

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(b" "))}


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``word_counts``. At most ``LISTED`` short rows come to the driver."""
    totals = {r.rare_class: r for r in counts.groupBy("rare_class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    distinct = sum(r.v for r in totals.values())
    # words above the count of the first that is too many; ties at the cut are not listed
    cut = kth_largest(counts, "n", LISTED + 1) if distinct > LISTED else 0
    top = counts.filter((F.col("n") > cut) | (F.col("word") == F.lit(bytearray(END)))).select("word", "n").collect()
    seen = {bytes(r.word): r.n for r in sorted(top, key=lambda r: (-r.n, r.word))}
    # the end has outputs of its own, whatever its count
    ends = seen.pop(END, 0)
    words = [END, *seen]
    number = np.array([ends, *seen.values()], np.int64)
    size = min(MODELLED, len(words))
    rare = np.array([rare_class(w) for w in words])
    codes = np.where(np.arange(len(words)) < size, np.arange(len(words)), size + rare)
    n_rare, v_rare = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
    for c, r in totals.items():
        n_rare[c], v_rare[c] = r.n, r.v
    own = number[:size] > 0
    np.subtract.at(n_rare, rare[:size], number[:size])
    np.subtract.at(v_rare, rare[:size][own], 1)
    return Vocabulary(
        b" ".join(words),
        codes.astype(np.int32),
        number,
        size,
        sum(r.n for r in totals.values()),
        distinct,
        -np.log(np.maximum(n_rare, 0) + np.maximum(v_rare, 0) + 1),
    )


class Model:
    """Next word from the state: first its class, then the word among its class."""

    def __init__(self, vocab: Vocabulary, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.size, self.classes = vocab.size, vocab.classes
        self.layer = gru.new_layer(rng, vocab.size + RARE_CLASSES, HIDDEN)
        # biases start at the corpus counts, so an untrained model is a unigram model
        own = vocab.counts[: vocab.size] + 1.0
        of_class = np.add.reduceat(own, np.arange(0, vocab.size, IN_CLASS))
        rare = np.exp(-vocab.rare_log)
        mass = np.concatenate((of_class, rare))
        self.out = {
            "class": rng.normal(0, 0.05, (HIDDEN, self.classes + RARE_CLASSES)).astype(np.float32),
            "class_bias": np.log(mass / mass.sum()).astype(np.float32),
            "word": rng.normal(0, 0.05, (vocab.size, HIDDEN)).astype(np.float32),
            "word_bias": np.log(own / np.repeat(of_class, IN_CLASS)[: vocab.size]).astype(np.float32),
        }

    def arrays(self) -> dict[str, np.ndarray]:
        return {f"layer.{k}": v for k, v in self.layer.items()} | self.out

    def packed(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.arrays().values()]).astype(np.float32).tobytes()

    def load(self, weights: np.ndarray) -> None:
        at = 0
        for v in self.arrays().values():
            v[...] = weights[at : at + v.size].reshape(v.shape)
            at += v.size

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < self.size, codes // IN_CLASS, codes - self.size + self.classes)

    def outputs(
        self, states: np.ndarray, codes: np.ndarray, grads: dict[str, np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each code, and with ``grads`` the gradient of the states.

        For a rare class it is that of the class alone.
        """
        o, target = self.out, self.class_of(codes)
        log_p = np.empty(len(codes))
        d_states = None if grads is None else np.empty_like(states)
        for at in range(0, len(codes), CHUNK):
            part = slice(at, at + CHUNK)
            h = states[part]
            p, log_p[part] = _softmax(o["class"].T @ h.T + o["class_bias"][:, None], target[part], grads is not None)
            if grads is not None:
                grads["class"] += (p @ h).T
                grads["class_bias"] += p.sum(axis=1)
                d_states[part] = (o["class"] @ p).T
        order = np.argsort(target, kind="stable")
        cuts = np.searchsorted(target[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            chosen = order[cuts[c] : cuts[c + 1]]
            if not len(chosen):
                continue
            part = slice(c * IN_CLASS, min((c + 1) * IN_CLASS, self.size))
            h = states[chosen]
            logits = o["word"][part] @ h.T + o["word_bias"][part, None]
            p, more = _softmax(logits, codes[chosen] - c * IN_CLASS, grads is not None)
            log_p[chosen] += more
            if grads is not None:
                grads["word"][part] += p @ h
                grads["word_bias"][part] += p.sum(axis=1)
                d_states[chosen] += p.T @ o["word"][part]
        return log_p, d_states

    def windows(self, docs: list[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """``(lane numbers, codes, keep, is first)`` of groups of documents of like length."""
        sizes = np.array([len(d) for d in docs])
        flat, firsts = np.concatenate([*docs, [0]]), np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), lanes):
            group = order[at : at + lanes]
            longest = int(sizes[group[0]])
            for start in range(0, longest, WINDOW):
                live = group[sizes[group] > start]
                place = np.arange(start, min(start + WINDOW, longest))[:, None]
                inside = place < sizes[live]
                yield live, flat[np.where(inside, firsts[live] + place, -1)], inside.astype(np.float32), start == 0

    def _before(self, h: np.ndarray, after: np.ndarray) -> np.ndarray:
        return np.concatenate((h[None], after[:-1]))

    def score(self, docs: list[np.ndarray], lanes: int = 512) -> np.ndarray:
        """Natural log probability of each document's codes, its state carried through."""
        total = np.zeros(len(docs))
        h = np.zeros((0, HIDDEN), np.float32)
        for live, codes, keep, first in self.windows(docs, lanes):
            h = np.zeros((len(live), HIDDEN), np.float32) if first else h[: len(live)]
            after = gru.states(self.layer, codes, keep, h)
            there = keep > 0
            log_p = np.zeros(codes.shape)
            log_p[there] = self.outputs(self._before(h, after)[there], codes[there])[0]
            total[live] += log_p.sum(axis=0)
            h = after[-1]
        return total

    def train(self, docs: list[np.ndarray], rate: float, lanes: int = LANES) -> None:
        """One pass of truncated backpropagation: gradients stop at a window, states at a document's end.

        Documents stand one behind the other and are cut into lanes of equal length, so that
        every step but the last reads ``lanes`` whole windows.
        """
        flat = np.concatenate(docs) if docs else np.empty(0, np.int64)
        if not len(flat):
            return
        lanes = max(1, min(lanes, len(flat) // (8 * WINDOW)))
        length = -(-len(flat) // lanes)
        more = np.ones(len(flat), np.float32)
        more[np.cumsum([len(d) for d in docs if len(d)]) - 1] = 0

        def dealt(values: np.ndarray) -> np.ndarray:
            return np.pad(values, (0, lanes * length - len(flat))).reshape(lanes, length).T

        codes, more, keep = dealt(flat), dealt(more), dealt(np.ones(len(flat), bool))
        adam, h = gru.Adam(rate), np.zeros((lanes, HIDDEN), np.float32)
        scale = np.float32(1 / (WINDOW * lanes))
        for at in range(0, length, WINDOW):
            ids, there = codes[at : at + WINDOW], keep[at : at + WINDOW]
            kept, go = there.astype(np.float32), more[at : at + WINDOW]
            tape: list = []
            after = gru.forward(self.layer, ids, kept, h, tape, go)
            grads = {k: np.zeros_like(v) for k, v in self.out.items()}
            _, d = self.outputs(self._before(h, after)[there], ids[there], grads)
            d_before = np.zeros_like(after)
            d_before[there] = d * scale
            d_after = np.concatenate((d_before[1:], np.zeros_like(d_before[:1])))
            grads = {k: v * scale for k, v in grads.items()}
            layer = gru.backward(self.layer, ids, kept, tape, d_after, go)
            adam.step(self.arrays(), grads | {f"layer.{k}": v for k, v in layer.items()})
            h = after[-1]


def _softmax(logits: np.ndarray, target: np.ndarray, with_gradient: bool) -> tuple[np.ndarray, np.ndarray]:
    """For ``(choice, row)`` logits, which are used up: their gradient and the target's log probability.

    Rows lie along the fast axis, so that all sums run over whole vectors.
    """
    rows = np.arange(len(target))
    logits -= logits.max(axis=0)
    picked = logits[target, rows]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    if with_gradient:
        logits /= total
        logits[target, rows] -= 1
    return logits, (picked - np.log(total)).astype(np.float64)


def _codes(
    index: dict[bytes, int], vocab: Vocabulary, found: list[bytes]
) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places in the list (-1: not listed), model codes of tokens, and those not listed."""
    at = np.fromiter(map(index.get, found, repeat(-1)), np.int64, len(found))
    codes = vocab.codes[at].astype(np.int64)
    absent = np.flatnonzero(at < 0)
    others = list(map(found.__getitem__, absent.tolist()))
    codes[absent] = [vocab.size + crc32(w[-3:]) % RARE_CLASSES for w in others]
    return at, codes, others


def _dealt(texts: DataFrame, vocab: Vocabulary, copies: int) -> DataFrame:
    """``copy, key, segment, codes``: the codes of ``texts``, dealt by hash into ``copies``.

    A document longer than a segment goes to several copies. Rows with equal id and text
    would all meet in one copy, so they are merged, first in their tasks.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        index = known.index()
        for piece in pieces(batches, 4 << 20):
            keys, segments, codes = [], [], []
            for key, text in zip(piece.column(0).to_pylist(), utf8(piece.column(1))):
                found = _codes(index, known, tokens(text))[1].astype(np.uint16)
                for k, at in enumerate(range(0, len(found), SEGMENT)):
                    keys.append(key)
                    segments.append(k)
                    codes.append(found[at : at + SEGMENT].tobytes())
            yield rows_out(SEGMENT_ROWS, [keys, segments, codes])

    keyed = texts.select(F.xxhash64(F.lit(4), "doc_id", "text").alias("key"), F.col("text").cast("string"))
    copy = F.pmod(F.xxhash64(F.lit(5), "key", "segment"), F.lit(copies)).alias("copy")
    rows = keyed.mapInArrow(run, "key long, segment int, codes binary")
    return rows.groupBy("key", "segment").agg(F.min("codes").alias("codes")).select(copy, "key", "segment", "codes")


def _trainer(shared: Broadcast, rate: float) -> Callable[[pa.Table], pa.Table]:
    """Trains a copy on its rows in the order of their hashes."""

    def run(rows: pa.Table) -> pa.Table:
        known, weights = shared.value
        own = Model(known)
        own.load(np.frombuffer(weights, np.float32))
        rows = rows.sort_by([("key", "ascending"), ("segment", "ascending")])
        docs = [np.frombuffer(c, np.uint16).astype(np.int64) for c in rows.column("codes").to_pylist()]
        own.train(docs, rate)
        return pa.Table.from_batches([rows_out(WEIGHT_ROWS, [[own.packed()], [float(sum(map(len, docs)))]])])

    return run


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model, trained on all rows of ``texts (doc_id, text)``; repeats of a row once.

    Documents are dealt by hash to copies of about ``COPY_TOKENS`` tokens, so neither files
    nor cores change the model. In every round the copies whose turn it is start from the
    shared weights and read their documents in the order of their hashes; then they are
    averaged by tokens, first in tasks, so that the driver gets a few rows only. The copies
    take turns until each was read as often as every round needs to have one: once, if there
    are as many copies as rounds.
    """
    model = Model(vocab)
    spark = texts.sparkSession
    copies = max(1, -(-vocab.n // COPY_TOKENS))
    passes = -(-rounds // copies)
    path = staging_path(spark, "codes")
    turn = F.pmod("copy", F.lit(rounds)).cast("int").alias("turn")
    _dealt(texts, vocab, copies).select("*", turn).write.partitionBy("turn").parquet(path)
    dealt = spark.read.schema("copy long, key long, segment int, codes binary, turn int").parquet(path)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, model.packed()))
        now = dealt.filter(F.col("turn").isin([(k - p * copies) % rounds for p in range(passes)]))
        parts = now.groupBy("copy").applyInArrow(_trainer(shared, RATE / (k + 1)), "weights binary, tokens double")
        found = parts.repartition(8).mapInArrow(_summed, "weights binary, tokens double").collect()
        total = sum(r.tokens for r in found)
        if total:
            model.load(sum(np.frombuffer(r.weights, np.float64) * (r.tokens / total) for r in found))
    drop_staged(spark, path)
    return model


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the weights that reach a task, in double precision, and their tokens."""
    mean, n = None, 0.0
    for batch in batches:
        for weights, tokens_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = np.frombuffer(weights, np.float32).astype(np.float64)
            n += tokens_
            mean = new if mean is None else mean + (new - mean) * (tokens_ / n)
    if mean is not None:
        yield rows_out(WEIGHT_ROWS, [[mean.tobytes()], [n]])


def _parts(texts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """A row a document, and a row for each of its words that is not listed."""
    shared = texts.sparkSession.sparkContext.broadcast((vocab, model.packed()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        index, own = known.index(), Model(known)
        own.load(np.frombuffer(weights, np.float32))
        log_counts = np.log10(known.counts + 1.0)
        rare_listed = known.codes >= known.size
        rid = TaskContext.get().partitionId() << 40
        for piece in pieces(batches):
            ids = piece.column(0).to_pylist()
            found = [tokens(t) for t in utf8(piece.column(1))]
            coded = [_codes(index, known, f) for f in found]
            scores = own.score([c for _, c, _ in coded]) / log(10)
            rows, words_of, counts_of, sizes = [], [], [], []
            for doc_id, words, (at, codes, absent), score in zip(ids, found, coded, scores.tolist()):
                rid += 1
                listed = at[at >= 0]
                rare = codes[codes >= known.size] - known.size
                score += float(known.rare_log[rare].sum()) / log(10)
                score += float(log_counts[listed[rare_listed[listed]]].sum())
                known_here = int((known.counts[listed] > 0).sum())
                sums = float(log_counts[listed].sum())
                rows.append((rid, doc_id, b" %d" % rid, 0, len(words), known_here, sums, score))
                others = Counter(absent)
                words_of += others
                counts_of += others.values()
                sizes.append(len(others))
            if rows:
                yield rows_out(PART_ROWS, map(list, zip(*rows)))
            if words_of:
                last = np.arange(rid - len(sizes) + 1, rid + 1)
                none, zero = np.zeros(len(words_of), np.int64), np.zeros(len(words_of))
                no_ids = pa.nulls(len(words_of), pa.int64())
                yield rows_out(
                    PART_ROWS, [np.repeat(last, sizes), no_ids, words_of, counts_of, none, none, zero, zero]
                )

    return texts.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PART_DDL)


def document_scores(docs: DataFrame, folds: int = 7) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are the words of a text between ASCII white space, A-Z lower-cased, and one
    end. Counts cover all documents whose id's crc32 modulo ``folds`` is not 2, and so
    does the model: its class and word probabilities start from these counts, and it is
    trained on all of these documents, dealt by hash, whatever files or tasks they come from.

    ``base_score`` sums the log10 of ``(c + 1) / (N + V + 1)``. ``score`` is the log10
    probability of the model: the state after all earlier tokens of the document gives
    the class of the next, and the word in its class. Frequent words have outputs of
    their own; others belong to a class by their ending, in which a word has
    ``(c + 1) / (N_class + V_class + 1)``. Words that are not listed are joined with
    their counts, so no count is lost.

    Null, empty and blank texts are one end. Rows stand alone, so repeated rows come
    back each; rows without id count as training documents. Without any training
    document all counts are zero. Only ``doc_id`` and ``text`` are read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    learned = texts.filter(~held_out(F.col("doc_id"), folds))
    counts = cut_lineage(word_counts(learned))
    vocab = vocabulary(counts)
    model = train(learned, vocab)
    c = F.coalesce(F.col("c"), F.lit(0))
    more = F.col("n") * F.log10(c + 1)
    joined = _parts(texts, vocab, model).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    sums = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("log_counts") + more).alias("log_counts"),
        F.sum(F.col("score") + more).alias("score"),
    )
    whole = float(np.log10(vocab.n + vocab.distinct + 1))
    return sums.select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )
