"""Token counts of whole texts with a whole-token shortcut in front of the merges."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ligatable.llm.common import pieces, rows_out, small_batches

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: Pre-tokens whose counts a worker keeps before it starts again with the proven ones.
KEPT = 200_000

#: The pre-token rule of the tokenizer file, for the letters below U+0180.
#: In this range lower-casing needs no context, stays in the range, and no character
#: is changed by composition, so the rule can be run on ``str.lower()``.
_RANGE = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c != 0x130]
_LETTERS = "".join(re.escape(c) for c in _RANGE if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _RANGE if unicodedata.category(c)[0] == "N")
PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t\n\r {_LETTERS}{_NUMBERS}]+"
)
OUTSIDE = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def n_tokens(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def whole_tokens(path: str, word_end: str = "</w>") -> list[str]:
    """The vocabulary strings that, as a text of their own, are one pre-token and one token.

    Every candidate is proven with the library, once, before any document is read.
    Its number is bounded by the vocabulary.
    """
    tokenizer = load(path)
    strings = {t.removesuffix(word_end) for t in tokenizer.get_vocab() if t.endswith(word_end)}
    plain = sorted(s for s in strings if s.isascii() and PRE_TOKEN.fullmatch(s) and s == s.lower())
    return [s for s, n in zip(plain, n_tokens(tokenizer, plain)) if n == 1]


class Counter:
    """Counts the tokens of texts as the library does, special strings included."""

    def __init__(self, path: str, whole: list[str]):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = whole
        self.known = dict.fromkeys(whole, 1)

    def merge(self, pre: list[str]) -> None:
        """Learn the counts of pre-tokens that are not known yet."""
        if len(self.known) > KEPT:
            self.known = dict.fromkeys(self.whole, 1)
        new = [p for p in set(pre) if p not in self.known]
        self.known.update(zip(new, n_tokens(self.tokenizer, new)))

    def count(self, text: str) -> int:
        if OUTSIDE.search(text) or any(s in text for s in self.special):
            return n_tokens(self.tokenizer, [text])[0]
        pre = PRE_TOKEN.findall(text.lower())
        try:
            return sum(map(self.known.__getitem__, pre))
        except KeyError:
            self.merge(pre)
            return sum(map(self.known.__getitem__, pre))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs (doc_id, text)``.

    Counts equal those of the ``tokenizers`` library without added tokens, padding or
    truncation, with its default for special strings inside a text. A text is cut into
    pre-tokens; those proven to be one token count at once, others are merged by the
    library and remembered. A text with characters at or above U+0180, control
    characters or special strings goes to the library whole. Null and empty texts
    have no bytes and no tokens. Each row stands alone: repeated rows and null ids
    come back as they are. Only ``doc_id`` and ``text`` are read. The proven strings
    travel with the task; their number is bounded by the vocabulary.
    """
    small_batches(docs.sparkSession)
    whole = whole_tokens(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, whole)
        for piece in pieces(batches):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            counts = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield rows_out(COUNTS, [piece.column(0), sizes, counts, [n > limit for n in counts]])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
