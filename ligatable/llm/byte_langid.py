"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligatable.llm import gru
from ligatable.llm.common import LOWER, held_out, pieces, rows_out, small_batches, utf8

HIDDEN = 16
#: Longest run of bytes that is read at once; longer words are read in such runs.
RUN = 32
#: Languages, labelled documents a language, and words of each, that training reads at most.
MOST_LANGS, DOCS_A_LANG, WORDS_A_DOC = 500, 300, 60
EPOCHS = 4
#: Words whose labels a worker remembers before it starts anew.
REMEMBERED = 200_000
UNKNOWN = "und"

#: Bytes that are part of letters, by and large: the positions that are pooled.
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)] + [False])


def runs(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased; long ones in runs of ``RUN`` bytes."""
    words = text.translate(LOWER).split()
    if max(map(len, words), default=0) <= RUN:
        return words
    return [w[i : i + RUN] for w in words for i in range(0, len(w), RUN)]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(time, word)`` byte numbers, 256 behind the end, and 1 where a byte is."""
    longest = max(map(len, words))
    ids = np.full((longest, len(words)), 256, np.int64)
    for i, w in enumerate(words):
        ids[: len(w), i] = np.frombuffer(w, np.uint8)
    return ids, (ids < 256).astype(np.float32)


class Labeller:
    """Labels every byte of a word, reading it in both directions."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        #: The score that labelled documents of every language usually reach.
        self.usual = 1.0
        self.there, self.back = gru.new_layer(rng, 257, HIDDEN), gru.new_layer(rng, 257, HIDDEN)
        self.out = {
            "o": rng.normal(0, 0.1, (2 * HIDDEN, len(langs))).astype(np.float32),
            "c": np.zeros(len(langs), np.float32),
        }

    def _states(self, ids: np.ndarray, keep: np.ndarray, tapes: tuple | None = None) -> np.ndarray:
        h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        there = gru.forward(self.there, ids, keep, h, tapes and tapes[0])
        # behind a word's end the state stays zero, so reading backwards starts at its last byte
        back = gru.forward(self.back, ids[::-1], keep[::-1], h, tapes and tapes[1])[::-1]
        return np.concatenate((there, back), axis=2)

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.out["o"] + self.out["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Per word of at most ``RUN`` bytes the sum of its letters' probabilities, and their number."""
        sums = np.zeros((len(words), len(self.langs) + 1), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(words), 4096):
            chosen = order[at : at + 4096]
            ids, keep = padded([words[i] for i in chosen])
            weight = LETTER[ids][:, :, None].astype(np.float32)
            p = self._probabilities(self._states(ids, keep))
            sums[chosen] = np.concatenate(((p * weight).sum(axis=0), weight.sum(axis=0)), axis=1)
        return sums

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> None:
        """Backpropagation through time; every letter of a word is to get its label."""
        rng, adam = np.random.default_rng(seed), gru.Adam(0.01)
        size = 512
        total = epochs * max(1, len(words) // size)
        done = 0
        lengths = np.array([len(w) for w in words])
        for _ in range(epochs):
            # words of like length share a batch; batches come in random order
            order = np.argsort(lengths + rng.random(len(words)), kind="stable")
            for at in rng.permutation(np.arange(0, len(words), size)):
                chosen = order[at : at + size]
                ids, keep = padded([words[i] for i in chosen])
                tapes: tuple[list, list] = ([], [])
                states = self._states(ids, keep, tapes)
                d = self._probabilities(states)
                d[:, np.arange(len(chosen)), labels[chosen]] -= 1
                weight = LETTER[ids].astype(np.float32)
                d *= (weight / max(1.0, float(weight.sum())))[:, :, None]
                back = d @ self.out["o"].T
                grads = {"o": np.einsum("tbh,tbl->hl", states, d, optimize=True), "c": d.sum(axis=(0, 1))}
                one = gru.backward(self.there, ids, keep, tapes[0], np.ascontiguousarray(back[:, :, :HIDDEN]))
                two = gru.backward(
                    self.back, ids[::-1], keep[::-1], tapes[1], np.ascontiguousarray(back[::-1, :, HIDDEN:])
                )
                grads |= {f"t{k}": v for k, v in one.items()} | {f"b{k}": v for k, v in two.items()}
                params = self.out | {f"t{k}": v for k, v in self.there.items()} | {f"b{k}": v for k, v in self.back.items()}
                done += 1
                adam.step(params, grads, 1.0 - 0.9 * done / total)


class _Index(dict):
    """Numbers words in order of appearance and lists the new ones."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _training_words(labelled: DataFrame) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
    """Languages, words, and by word its language and document, of a bounded, hashed sample of labelled documents, evenly spaced in each.

    At most ``DOCS_A_LANG * WORDS_A_DOC`` words a language come to the driver, from the
    ``MOST_LANGS`` languages with the most labels. Ids are chosen first, without texts,
    in two steps, so that no task gathers the choices of all others.
    """
    told = labelled.select("doc_id", "lang", F.xxhash64(F.lit(3), "doc_id").alias("order"))
    common = told.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).select("lang")
    chosen = told.join(F.broadcast(common), "lang").withColumn("part", F.pmod("order", F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "doc_id"))
        chosen = chosen.withColumn("n", first).filter(F.col("n") <= DOCS_A_LANG)
    # at most DOCS_A_LANG ids a language
    ids = F.broadcast(chosen.select("doc_id", "lang").distinct())
    sample = labelled.join(ids, ["doc_id", "lang"]).dropDuplicates(["doc_id"]).filter(F.col("text").rlike(r"\p{L}"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    step = F.greatest(F.lit(1), F.floor(F.size("w") / WORDS_A_DOC)).cast("int")
    picked = F.slice(F.filter("w", lambda _, i: i % F.col("step") == 0), 1, WORDS_A_DOC)
    rows = (
        sample.withColumn("w", words)
        .withColumn("step", step)
        .select("lang", F.transform(picked, lambda x: F.substring(x, 1, RUN)).alias("w"))
        .collect()
    )
    rows.sort(key=lambda r: (r.lang, r.w))
    langs = sorted({r.lang for r in rows})
    found = [(w.encode().translate(LOWER)[:RUN], langs.index(r.lang), i) for i, r in enumerate(rows) for w in r.w if w]
    return langs, [w for w, _, _ in found], *(np.array([x[k] for x in found], np.int64) for k in (1, 2))


def learn(labelled: DataFrame) -> Labeller | None:
    """A labeller from ``labelled (doc_id, text, lang)``; none if there is nothing to learn."""
    langs, words, labels, of = _training_words(labelled.filter("lang is not null"))
    if not words:
        return None
    labeller = Labeller(langs)
    labeller.train(words, labels)
    labeller.usual = usual_score(labeller, words, labels, of)
    return labeller


def usual_score(labeller: Labeller, words: list[bytes], labels: np.ndarray, of: np.ndarray) -> float:
    """What 99 of 100 labelled documents reach, in the language where that is least."""
    least = 1.0
    for lang in np.unique(labels):
        at = np.flatnonzero(labels == lang)
        sums = np.zeros((len(at), len(labeller.langs) + 1))
        np.add.at(sums, np.unique(of[at], return_inverse=True)[1], labeller.pooled([words[i] for i in at]))
        sums = sums[sums[:, -1] > 0]
        if len(sums):
            least = min(least, float(np.quantile(sums[:, :-1].max(axis=1) / sums[:, -1], 0.01)))
    return least


def identify(docs: DataFrame, labeller: Labeller | None) -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang_pred`` and ``score`` of every row.

    White space parts a text, A-Z lower-cased, into words, and long words into runs of ``RUN`` bytes; the
    network reads every one of them, from zero states, in both directions, and gives
    each byte a distribution over languages. A document's distribution is the mean over
    all its letter bytes, its score that of the language found. Equal words have equal
    labels, so a task labels each distinct word once and remembers it for a while.

    Null texts, texts without a letter and any text where nothing was learned get
    ``und`` with score 0. Rows stand alone; only the text is read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("string")).alias("text"),
    )
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = _Index(), np.empty((0, 0), np.float32)
        for piece in pieces(batches):
            texts = [utf8(piece.column(1)), piece.column(1).is_valid().to_pylist()]
            found: list[tuple[str, float]] = []
            if labeller:
                at = [np.fromiter(map(index.__getitem__, words), np.int64) for words in map(runs, texts[0])]
                if index.new:
                    fresh = labeller.pooled(index.new)
                    table = np.concatenate((table, fresh)) if len(table) else fresh
                    index.new = []
            for i, has_letter in enumerate(texts[1]):
                sums = table[at[i]].sum(axis=0, dtype=np.float64) if labeller and has_letter else np.zeros(2)
                if sums[-1]:
                    best = int(sums[:-1].argmax())
                    found.append((labeller.langs[best], min(1.0, float(sums[best] / sums[-1]))))
                else:
                    found.append((UNKNOWN, 0.0))
            if len(index) > REMEMBERED:
                index, table = _Index(), np.empty((0, 0), np.float32)
            out = [piece.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame, folds: int = 4) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the documents not held out."""
    labeller = learn(docs.filter(~held_out(F.col("doc_id"), folds)).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), labeller)
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id, folds).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, folds: int = 4, least: float = 0.3, share: float = 0.9) -> DataFrame:
    """``docs`` without those of no language.

    These are texts without a letter, and texts whose score is below ``least`` and below
    ``share`` of what labelled documents usually reach. That follows the number of
    languages, how related they are, and how much could be learned. Where nothing was
    learned only texts without a letter go.
    """
    labeller = learn(docs.filter(~held_out(F.col("doc_id"), folds)).select("doc_id", "text", "lang"))
    if labeller is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = min(least, share * labeller.usual)
    found = identify(docs, labeller).filter(F.col("lang_pred") != UNKNOWN).filter(F.col("score") >= least)
    return found.select("row.*")
