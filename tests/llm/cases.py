"""Awkward documents that every operator has to take, and small brute-force helpers."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
TEXT = "The quick brown fox jumps over the lazy dog while nobody looks at the moon"

ROWS = [
    (1, TEXT, "en", "b", 5),
    (1, TEXT, "en", "b", 5),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, " \t\n\r ", "de", "a", 5),
    (5, LONG, "en", "b", len(LONG)),
    (6, "x" * 50_000, None, None, 50_000),
    (None, TEXT, "en", "c", 9),
    (None, None, None, None, None),
    (7, "Ünïcödé 日本語 text — naïve\nsecond line of the text here\n\n", "de", "c", 3),
    (8, TEXT + "!", None, "a", 1),
]

#: Names that the operators use inside.
EXTRA = ("row", "site", "n", "kept", "spans", "items", "word", "d1", "pos", "bin", "fp", "score", "of", "repeat", "at.x")


def documents(spark, rows=ROWS):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for i, name in enumerate(EXTRA):
        docs = docs.selectExpr("*", f"{i} as `{name}`")
    return docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
