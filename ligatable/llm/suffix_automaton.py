"""Benchmark decontamination with a generalised suffix automaton over item words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligatable.llm.common import LOWER, hash_table, pieces, small_batches, utf8, word_hashes
from ligatable.operators.skew import salted_join
from ligatable.session import cut_lineage

#: Lower-cased word bytes stay, all others become spaces.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER)
WORD = re.compile(rb"[^ ]+")
#: Words of the items that one automaton holds, about; more items make more automata.
AUTOMATON_WORDS = 100_000
#: Bits of the filter of window keys: so many for each item word, and at most ``2^28`` (32 MB).
BITS_A_WORD, LEAST_BITS, MOST_BITS = 128, 16, 28
#: The filter looks at these places of a key.
SHIFTS = (0, 12, 24, 36)
#: Bytes of text that one task holds beside one automaton, about.
PART_BYTES = 32 << 20
#: Bytes of text whose words are hashed at once.
HASHED_BYTES = 1 << 20
#: Odd numbers of 64 bits: the base of window keys, and factors that mix them.
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """All substrings of the items' word sequences, and the items behind each window.

    States hold classes of substrings that end at the same places. ``ids`` numbers the
    words of the items from 1; a word that no item has ends every match.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.size = [{}], [-1], [0]
        ends = []
        for name, item in items:
            at, path = 0, []
            for w in item:
                at = self._add(at, self.ids.setdefault(w, len(self.ids) + 1))
                path.append(at)
            ends.append((name, path))
        self.shortest = min((min(len(p), window) for _, p in ends if p), default=0)
        self._mark(ends)

    def _state(self, size: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, at: int, c: int) -> int:
        """The state of the strings of ``at`` extended by ``c``, made exact if need be."""
        q = self.next[at][c]
        if self.size[q] == self.size[at] + 1:
            return q
        copy = self._state(self.size[at] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while at >= 0 and self.next[at].get(c) == q:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, at = self._state(self.size[last] + 1, {}, 0), last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, c)
        return new

    def _mark(self, ends: list[tuple[str, list[int]]]) -> None:
        """Per state: its class of window-long suffixes, and short items that end there."""
        window, n = self.window, len(self.size)
        self.of_window = [-1] * n
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * n
        own: dict[int, list[tuple[int, str | None]]] = {}
        for name, path in ends:
            if path and len(path) < window:
                own.setdefault(path[-1], []).append((len(path), name))
        for s in sorted(range(1, n), key=self.size.__getitem__):
            up = self.link[s]
            if self.size[s] >= window:
                self.of_window[s] = s if self.size[up] < window else self.of_window[up]
            self.short[s] = self.short[up] + tuple(own.get(s, ()))
        self.items: dict[int, set[str | None]] = {}
        for name, path in ends:
            for at in path:
                if self.of_window[at] >= 0:
                    self.items.setdefault(self.of_window[at], set()).add(name)

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Runs of hit words as ``(first, end)``, and the items whose windows occur."""
        codes = np.fromiter(map(self.ids.get, text_words, repeat(0)), np.int64, len(text_words))
        inside = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
        hits: list[list[int]] = []
        found: set[str | None] = set()
        for first, end in zip(inside[::2].tolist(), inside[1::2].tolist()):
            if end - first >= self.shortest:
                self._run(codes[first:end].tolist(), first, hits, found)
        merged: list[list[int]] = []
        for a, b in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged], found

    def _run(self, codes: list[int], first: int, hits: list[list[int]], found: set[str | None]) -> None:
        follow, link, size, window = self.next, self.link, self.size, self.window
        state = length = 0
        for i, c in enumerate(codes, first + 1):
            while c not in follow[state]:
                state = link[state]
                length = size[state]
            state = follow[state][c]
            length += 1
            if length >= window:
                hits.append([i - window, i])
                found |= self.items[self.of_window[state]]
            for n, name in self.short[state]:
                if n <= length:
                    hits.append([i - n, i])
                    found.add(name)


def text_hashes(text: bytes, table: np.ndarray) -> np.ndarray:
    """A hash for each word of a text, which is worked through in chunks cut between words."""
    data, out, at = text.translate(WORD_BYTES), [], 0
    while at < len(data):
        end = data.find(b" ", at + HASHED_BYTES)
        end = len(data) if end < 0 else end
        out.append(word_hashes(data[at:end], table)[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def window_keys(hashes: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each size: 64-bit keys of all runs of so many words, in order."""
    total = np.zeros(len(hashes), np.uint64)
    for j in range(min(max(sizes, default=0), len(hashes))):
        total = total[: len(hashes) - j] + hashes[j:] * np.uint64(pow(BASE, j, 1 << 64))
        if j + 1 in sizes:
            x = total + np.uint64(j + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
            yield x ^ (x >> np.uint64(31))


def _segments(window: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items as runs of at most ``most`` words that share no window, with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hash_table()
        for piece in pieces(batches):
            for text, names in zip(utf8(piece.column("text")), piece.column("names").to_pylist()):
                item, hashes = words(text), text_hashes(text, table)
                size = min(window, len(item))
                for at in range(0, len(item) - size + 1 if item else 0, most - window + 1):
                    keys = next(window_keys(hashes[at : at + most], [size]))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "segment": pa.array([b" ".join(item[at : at + most])], pa.binary()),
                            "names": pa.array([names], pa.list_(pa.string())),
                            "n": pa.array([len(item[at : at + most])], pa.int32()),
                            "size": pa.array([size], pa.int32()),
                            "keys": pa.array([np.unique(keys).view(np.int64)], pa.list_(pa.int64())),
                        }
                    )

    return run


def item_parts(items: DataFrame, window: int, part_words: int = AUTOMATON_WORDS) -> tuple[DataFrame, int, list[int]]:
    """``(part, segment, names, n, size, keys)`` of ``items (item_id, text)``, their words and window sizes.

    Each distinct text is one item with all its ids. Items are cut into runs of at most a
    quarter of ``part_words`` words, which overlap by a word less than a window, and dealt
    by hash to parts of about ``part_words``. Nothing of a text comes to the driver. Null and
    wordless items have no windows; rows that repeat an item change nothing. Items without
    id have windows like others, and one name, null.
    """
    small_batches(items.sparkSession)
    rows = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    # collect_set leaves nulls out, so names are wrapped
    texts = rows.filter("text is not null").groupBy("text").agg(F.collect_set(F.struct("name")).alias("names"))
    run = _segments(window, max(2 * window, part_words // 4))
    schema = "segment binary, names array<string>, n int, size int, keys array<long>"
    segments = cut_lineage(texts.select("text", F.col("names.name").alias("names")).mapInArrow(run, schema))
    total, sizes = segments.agg(F.sum("n"), F.collect_set("size")).first()
    parts = max(1, -(-(total or 0) // part_words))
    return segments.withColumn("part", F.pmod(F.xxhash64("segment"), F.lit(parts)).cast("int")), total or 0, sorted(sizes)


def key_filter(keys: DataFrame, words_in_items: int) -> np.ndarray:
    """A Bloom filter of ``keys (key)`` as 64-bit numbers, at most ``2^MOST_BITS`` bits.

    Its size follows the items up to that bound. A fuller filter lets more keys pass, which
    the join by key then drops; it never loses one.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_WORD * words_in_items - 1).bit_length()))
    place = F.explode(F.array(*(F.shiftrightunsigned("key", n).bitwiseAND(F.lit((1 << bits) - 1)) for n in SHIFTS)))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    filled = (
        keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[filled.column("at").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return table


def passing(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The distinct keys that the filter knows."""
    last = np.uint64(64 * len(table) - 1)
    for n in SHIFTS:
        place = (keys >> np.uint64(n)) & last
        keys = keys[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return np.unique(keys)


def _meeting(known: Broadcast, sizes: list[int], keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts words and finds the window keys of each text that pass the filter.

    Without ``keep`` only the texts that have such keys come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = hash_table(), known.value
        for piece in pieces(batches):
            counts, near = [], []
            for text in utf8(piece.column("text")):
                hashes = text_hashes(text, table)
                found = [passing(keys, bits) for keys in window_keys(hashes, sizes)]
                counts.append(len(hashes))
                near.append(np.concatenate(found).view(np.int64) if found else [])
            columns = {c: piece.column(c) for c in piece.schema.names}
            if not keep:
                wanted = pa.array([len(n) > 0 for n in near], pa.bool_())
                columns["text"] = pa.compute.if_else(wanted, columns["text"], pa.scalar(None, columns["text"].type))
            columns |= {"n_words": pa.array(counts, pa.int64()), "near": pa.array(near, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _streaming(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by part and salt, items first: builds the automaton, then streams the texts through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, names, automaton = None, [], [], None
        for piece in pieces(batches):
            keys, spans, found = [], [], []
            for row, text in zip(piece.drop_columns(["text"]).to_pylist(), utf8(piece.column("text"))):
                if at != (row["part"], row["salt"]):
                    at, items, names, automaton = (row["part"], row["salt"]), [], [], None
                if row["is_doc"]:
                    automaton = automaton or Automaton(items, window)
                    hits, which = automaton.scan(words(text))
                    if hits:
                        keys.append(row["id"])
                        spans.append([x for ab in hits for x in ab])
                        found.append(list(set().union(*(names[i] for i in which))))
                else:
                    items.append((len(items), text.split()))
                    names.append(row["names"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, piece.schema.field("id").type),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array(found, pa.list_(pa.string())),
                ],
                ["id", "spans", "items"],
            )

    return run


def _spans(texts: DataFrame, segments: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """``(id, spans, items)`` of the ``texts (id, text, near)`` that hold item windows, lists by part.

    Texts meet parts by the keys of their windows. A part's texts are dealt to as many
    tasks as their bytes ask for, each with the part's items; only these are repeated.
    """
    near = texts.select("id", F.explode("near").alias("key"))
    counts = near.groupBy("key").agg(F.count("*").alias("rows"))
    pairs = cut_lineage(salted_join(near, keys, "key", counts=counts).select("id", "part").distinct())
    met = pairs.join(texts.select("id", "text"), "id")
    salts = F.ceil(F.sum(F.octet_length("text")) / PART_BYTES + 1).cast("int").alias("salts")
    load = cut_lineage(met.groupBy("part").agg(salts))
    none = F.lit(None)
    docs = met.join(load, "part").select(
        "part",
        F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
        F.lit(True).alias("is_doc"),
        "id",
        F.col("text").cast("binary").alias("text"),
        none.cast("array<string>").alias("names"),
    )
    tools = segments.join(load, "part").select(
        "part",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(False).alias("is_doc"),
        none.cast(texts.schema["id"].dataType).alias("id"),
        F.col("segment").alias("text"),
        "names",
    )
    dealt = docs.unionByName(tools).repartition("part", "salt").sortWithinPartitions("part", "salt", "is_doc")
    found = dealt.mapInArrow(_streaming(window), "id struct<h1: long, h2: long>, spans array<int>, items array<string>")
    return found.groupBy("id").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))


def _in_order(names: set[str | None]) -> list[str | None]:
    """Sorted as strings, null first."""
    return sorted(names, key=lambda n: (n is not None, n or ""))


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    if not spans:
        return text
    at = [m.span() for m in WORD.finditer(text.translate(WORD_BYTES))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def _text_id(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def scan_documents(
    docs: DataFrame, items: DataFrame, window: int = 10, keep: bool = False, part_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """What of ``docs (doc_id, text)`` occurs in ``items (item_id, text)``.

    Words are runs of digits, letters and bytes from 0x80, A-Z lower-cased. A window is
    ``window`` consecutive words of an item; an item with fewer words, but not none, is
    one window. Document words stream through the automaton, which tracks the longest
    match that ends at each word; words inside an occurring window are hit.

    Items are dealt to parts of about ``part_words`` words, each an automaton that a task
    builds. A bounded filter of window keys tells which texts can hold a window; these meet
    the parts by a join on the keys, equal texts once. Other texts pass by no automaton and
    no shuffle. The benchmark's size changes neither that nor how often documents are read:
    once, and with ``keep`` three times.

    Returns ``doc_id, n_words, n_hit, items`` (ids with occurring windows, sorted as
    strings, null for items without id), and with ``keep`` also ``cleaned`` (the text without each hit span) and
    ``row`` (all columns but the text). Rows stand alone: repeated rows, null ids and
    extra columns come back; a null text has no words. Without items nothing is hit.
    """
    spark = docs.sparkSession
    segments, item_words, sizes = item_parts(items, window, part_words)
    keys = segments.select("part", F.explode("keys").alias("key")).distinct()
    known = spark.sparkContext.broadcast(key_filter(keys.select("key").distinct(), item_words))
    rest = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        _text_id(text).alias("id"),
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row") if keep else F.lit(None).cast("int").alias("row"),
    )

    def met(rows: DataFrame) -> DataFrame:
        schema = rows.withColumns({"n_words": F.lit(0).cast("long"), "near": F.array().cast("array<long>")}).schema
        return rows.mapInArrow(_meeting(known, sizes, keep), schema)

    rows = met(given) if keep else cut_lineage(met(given))
    some = F.size("near") > 0
    texts = (met(given.select("id", "text")) if keep else rows).filter(some)
    texts = cut_lineage(texts.groupBy("id").agg(F.min("text").alias("text"), F.first("near").alias("near")))
    spans = cut_lineage(_spans(texts, segments, keys, window))
    none = {"spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<array<string>>")}
    held = salted_join(rows.filter(some).drop("near"), spans, "id", "left")
    every = held.unionByName(rows.filter(~some).drop("near").withColumns(none))
    out = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "cleaned": F.col("text")}
    columns = ["doc_id", "n_words", "n_hit", "items", *(["cleaned", "row"] if keep else [])]
    schema = every.withColumns(out).select(*columns).schema
    return every.mapInArrow(_summing(columns), schema)


def _summing(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges what the parts found, and cuts it out of the texts if they are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hits, names = [], []
            for found, items in zip(piece.column("spans").to_pylist(), piece.column("items").to_pylist()):
                hits.append(_covered([ab for x in found or () for ab in zip(x[::2], x[1::2])]))
                names.append(_in_order(set().union(*(items or ()))))
            new = {
                "n_hit": pa.array([sum(b - a for a, b in x) for x in hits], pa.int64()),
                "items": pa.array(names, pa.list_(pa.string())),
            }
            if "cleaned" in columns:
                # a text without hits comes back as it is, null included
                texts = piece.column("text").to_pylist()
                cut = [without_spans(t.encode(), x).decode() if x else t for t, x in zip(texts, hits)]
                new["cleaned"] = pa.array(cut, pa.string())
            yield pa.RecordBatch.from_arrays([new[c] if c in new else piece.column(c) for c in columns], columns)

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, part_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Per document: counts, the number of item ids that occur, and a digest of them.

    Items without id make hits like others; having no id, they are neither counted nor listed.
    """
    named = F.array_compact("items")
    ids = F.array_join(named, ",")
    return scan_documents(docs, items, window, part_words=part_words).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(named).cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.8) -> DataFrame:
    """``docs`` with hit spans cut out; documents that consist of them go.

    A span is cut where a match reaches ``window`` words, or covers a whole item that
    is shorter. A document goes if at least ``coverage`` of its words are hit.
    """
    scanned = scan_documents(docs, items, window, keep=True)
    clean = scanned.filter((F.col("n_hit") == 0) | (F.col("n_hit") < coverage * F.col("n_words")))
    length = F.when(F.col("n_hit") > 0, F.length("cleaned").cast("long"))
    return clean.select(
        *(
            (
                F.col("cleaned")
                if c == "text"
                else F.coalesce(length, F.col("row.n_chars")).alias(c)
                if c == "n_chars"
                else F.col(f"row.`{c}`")
            ).alias(c)
            for c in docs.columns
        )
    )
