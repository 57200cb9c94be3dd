import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from cases import LOWER, ROWS, documents
from compare import differences, open_tables

from ligatable import session
from ligatable.llm import oracles, phrases, queries


def brute(rows, least, longest=5, top=2000):
    counts, sizes = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    found = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    inside = set()
    for (lang, w), f in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * f >= 100 * counts[lang, w[i : i + m]]:
                    inside.add((lang, w[i : i + m]))
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) in inside:
            continue
        cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, k = min((1000 * a * sizes[lang] // (l * r), k) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), *cuts[k]))
    return [
        (lang, rank, p.decode(), -a, l, r, sizes[lang], -score)
        for lang, rows in sorted(out.items())
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
    ]


def test_same_as_sql(spark, sf_dir):
    assert differences(queries.op12_collocations(spark, sf_dir), open_tables(sf_dir), oracles.OP12) == []


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("limit", [16 << 20, 700], ids=["large blocks", "small blocks"])
def test_random_texts_equal_brute_force(spark, monkeypatch, seed, limit):
    """Overlaps, pieces of all lengths, equal scores, languages by turns, and blocks cut at any mark."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", limit)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", min(limit, 100))
    rng = random.Random(seed)
    vocabulary = ["a", "A", "b", "é", "日本", "x\x1cy", "z z", "long" * 40, "d'e"]
    rows = []
    for i in range(120):
        text = "".join(
            rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\x0b", "\r\n", "!"])
            for _ in range(rng.choice([0, 1, 5, 80, 300]))
        )
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""]), "s", 1))
    got = phrases.collocations(documents(spark, rows).repartition(3), min_count=6, top=40)
    want = brute(rows, 6, top=40)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)


def test_awkward_documents(spark):
    got = phrases.collocations(documents(spark), min_count=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute(ROWS, 3))
    none = phrases.collocations(documents(spark, []))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(documents(spark, [(1, None, "en", "a", 0), (2, " .. ", None, "a", 0)])).count() == 0


def test_one_very_long_piece_and_one_very_long_word(spark):
    rows = [(1, "one two three " * 300_000, "en", "a", 1), (2, "w" * 3_000_000 + " one two", "en", "a", 1)]
    got = phrases.collocations(documents(spark, rows)).collect()
    n = 900_003
    assert [(r.phrase, r.a, r.n) for r in got] == [
        (r[2], r[3], n) for r in brute(rows, 100)
    ]


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts near 10^14 through the last step: products of more than 64 bits, floors and ties."""
    huge = 10**14
    rows = [(1, "p q", huge - 1, [huge + 7, huge - 1], [3 * huge, huge - 1]), (2, "r s", huge - 1, [huge + 7, huge - 1], [3 * huge + 1, huge - 1])]
    schema = "id long, phrase string, f long, firsts array<long>, lasts array<long>"
    two = spark.createDataFrame(rows, schema).selectExpr("*", "'en' lang", "phrase last", "null a", "null b")
    sizes = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    monkeypatch.setattr(phrases, "mine", lambda *_: ([two, two], sizes))
    got = {r.phrase: r.score for r in phrases.collocations(None).collect()}
    assert got == {p: 1000 * f * 9 * 10**15 // (x[0] * y[0]) for _, p, f, x, y in rows}


def test_relation_extends_within_pieces():
    places, groups = np.array([0, 1, 2, 4, 5, 9]), np.array([3, 1, 3, 1, 3, 7])
    at, found, a, b, n = phrases.extended(places, groups, np.array([7, 3, 1]), np.array([70, 30, 10]))
    assert at.tolist() == [0, 1, 4] and sorted(n.tolist()) == [1, 2]
    assert [(a[i], b[i]) for i in found] == [(30, 10), (10, 30), (10, 30)]


def test_shuffle_files_go_with_each_step(spark):
    """What a step shuffled is deleted once the step is written, and the session's setting stays as it was."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and x.endswith(".data")}

    setting = spark.conf.get(session.SHUFFLES_GO_CONF)
    docs = spark.createDataFrame([("red green blue. red green", "en")] * 200, "text string, lang string").repartition(2)
    before = shuffled()
    found = phrases.collocations(docs)
    until = time.time() + 10
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(session.SHUFFLES_GO_CONF) == setting
    assert {(r.phrase, r.a) for r in found.collect()} == {("red green", 400), ("red green blue", 200)}
