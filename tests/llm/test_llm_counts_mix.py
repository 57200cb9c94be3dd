import hashlib
import random

import pytest
from cases import ROWS, documents, words
from compare import differences, open_tables
from pyspark.sql import functions as F

from ligatable.llm import mixing, oracles, queries, suffix_automaton, token_counts

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(oracles.all_sql()))
def test_same_as_sql(spark, sf_dir, con, name):
    assert differences(queries.all_queries()[name](spark, sf_dir), con, oracles.all_sql()[name]) == []


HARD = [
    "don't we'll I'VE they're 'S ''s x'y 12,345 naïve ÀÉÎ ß ŒUVRE ſ",
    "<|endoftext|> in <|startoftext|>text<|endoftext|>",
    "日本語のテキスト と English",
    "İstanbul Σίσυφος ΑΣ ΟΔΟΣ",
    "a b c\x1cd\x85e\x00f",
    "é and é, Å",
    "😀 emoji 👩‍👩‍👧 ½ ² ª º ×",
    "supercalifragilisticexpialidocious" * 50,
    "a" * 5000,
    "﻿bom ­ soft",
    "",
]


def test_tokens_as_the_library_counts(spark, sf_dir):
    tokenizer = token_counts.load(PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + HARD
    counter = token_counts.Counter(PATH, token_counts.whole_tokens(PATH))
    assert [counter.count(t) for t in texts] == token_counts.n_tokens(tokenizer, texts)


def test_every_shortcut_is_one_token():
    whole = token_counts.whole_tokens(PATH)
    assert len(whole) > 20_000
    assert set(token_counts.n_tokens(token_counts.load(PATH), whole)) == {1}


def test_tokens_of_random_texts():
    rng = random.Random(3)
    tokenizer = token_counts.load(PATH)
    counter = token_counts.Counter(PATH, token_counts.whole_tokens(PATH))
    alphabet = "abcXYZ '\t\n12.,-éßØÿſ½²ªΣ日́ <|>"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(2000)]
    assert [counter.count(t) for t in texts] == token_counts.n_tokens(tokenizer, texts)


def test_token_cases(spark):
    rows = token_counts.token_counts(documents(spark), PATH).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id in (2, 3):
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (0, 0, False)
    assert [r.over_limit for r in rows if r.doc_id == 5] == [True]
    assert token_counts.token_counts(documents(spark, []), PATH).count() == 0


def iterated(sizes, weights, share=1.5, epochs=2.0):
    """Water-filling as told: clamp, reshare the excess by weight, until none is above."""
    total, closed = share * sum(sizes), {}
    while True:
        rest = total - sum(closed.values())
        open_ = [i for i in range(len(sizes)) if i not in closed]
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > epochs * sizes[i] + 1e-9]
        if not over:
            return [closed.get(i, rest * weights[i] / w if w else 0) for i in range(len(sizes))]
        closed |= {i: epochs * sizes[i] for i in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_as_iterated(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 3, 40, 500, 9000]) + rng.randrange(20) for _ in range(rng.randrange(1, 9))]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    table = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(iterated(sizes, weights))


def test_mix_meets_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_quotas(docs, keep=("source",)).collect()
    assert len(rows) == docs.count()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    assert sorted(rows) == sorted(mixing.mix_quotas(docs.repartition(5), keep=("source",)).collect())


def test_mixed_rows_hold_the_taken_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mix_quotas(docs).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
        if r.text != texts[r.doc_id]:
            assert set(r.text.split(" ")) <= set(texts[r.doc_id].split())
    assert got == {k: v for k, v in taken.items() if v}


def test_mix_cases(spark):
    docs = documents(spark)
    rows = mixing.mix_quotas(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    # a: 16 words, b: 30,030, c: 24, null: 1; a, c and null fill up
    assert {r.target for r in rows if r.doc_id == 8} == {2.0 * sum(len(words(t)) for i, t, _, s, _ in ROWS if s == "a")}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [c for c in docs.columns if c != "repeat"] + ["repeat"]
    assert mixed.count() > 0
    assert mixing.mix_quotas(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, None, None, "a", None), (2, "", None, None, None)])
    assert [r.taken for r in mixing.mix_quotas(blank).collect()] == [0, 0]


def brute_scan(text, items, window):
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(text) - n + 1):
            if n and tuple(text[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(name)
    return hit, found


@pytest.mark.parametrize("seed", range(40))
def test_automaton_as_brute_force(seed):
    rng = random.Random(seed)
    letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 6]))]
    items = [(str(i), rng.choices(letters, k=rng.randrange(9))) for i in range(rng.randrange(1, 6))]
    window = rng.randrange(1, 6)
    automaton = suffix_automaton.Automaton(items, window)
    for _ in range(20):
        text = rng.choices([*letters, b"?"], k=rng.randrange(30))
        hits, found = automaton.scan(text)
        want, names = brute_scan(text, items, window)
        assert {k for a, b in hits for k in range(a, b)} == want and found == names


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_decontamination_cases(spark):
    items = spark.createDataFrame(
        [(1, ITEM), (2, "Short Item!"), (3, None), (4, ""), (5, "..."), (1, ITEM), (None, "alpha beta")],
        "item_id long, text string",
    )
    inside = "Before it,\n" + ITEM.upper().replace(" ", " - ") + "; and after. SHORT, item"
    rows = [*ROWS, (50, inside, "en", "a", 1), (51, ITEM, "en", "a", 2), (52, "alpha beta gamma", "en", "a", 3)]
    docs = documents(spark, rows)
    done = {r.doc_id: r for r in suffix_automaton.contamination(docs, items).collect()}
    assert len(done) == len({r[0] for r in rows})
    assert (done[50].n_words, done[50].n_hit, done[50].n_items) == (18, 14, 2)
    assert done[50].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    # an item without id hits, but has no id to count or list
    assert (done[52].n_hit, done[52].n_items, done[52].contaminated) == (2, 0, True)
    assert done[52].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert done[2].n_words == 0 and done[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    clean = suffix_automaton.decontaminated(docs, items)
    assert clean.columns == docs.columns
    left = {r.doc_id: r for r in clean.collect()}
    assert left[50].text == "Before it,\n; and after. " and left[50].n_chars == len(left[50].text)
    assert 51 not in left and left[52].text == " gamma"
    assert left[2].text is None and left[3].text == ""
    assert clean.count() == len(rows) - 1
    none = items.limit(0)
    assert suffix_automaton.contamination(docs, none).filter("contaminated").count() == 0
    assert suffix_automaton.contamination(documents(spark, []), items).count() == 0


def test_items_of_several_automata(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(suffix_automaton.contamination(docs, items).collect())
    assert suffix_automaton.item_parts(items, 10, 400)[0].select("part").distinct().count() > 2
    assert sorted(suffix_automaton.contamination(docs, items, part_words=400).collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_scan_as_brute_force(spark, seed):
    """Few words, so windows overlap, repeat, lie in several parts and stand in cut items."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3)]
    window = 4
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 40])))) for i in range(20)]
    rows = [(i, " ".join(rng.choices([*vocabulary, "x", "y"], k=rng.randrange(60))), "en", "a", 1) for i in range(60)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert suffix_automaton.item_parts(table, window, 16)[0].select("part").distinct().count() > 1
    done = suffix_automaton.scan_documents(documents(spark, rows), table, window, part_words=16)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in done.collect()}
    split = [(str(i), t.split()) for i, t in items]
    for i, t, *_ in rows:
        hit, found = brute_scan(t.split(), split, window)
        assert got[i] == (len(t.split()), len(hit), sorted(found))


def test_full_filter_only_costs_time(spark, sf_dir, monkeypatch):
    """A filter so small that it knows every key drops nothing and adds nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(suffix_automaton.contamination(docs, items).collect())
    monkeypatch.setattr(suffix_automaton, "MOST_BITS", 8)
    assert sorted(suffix_automaton.contamination(docs, items).collect()) == want


def test_words_are_hashed_alike_in_chunks(monkeypatch):
    text = ("Some words, " * 50 + "x" * 200 + " ").encode() * 3
    whole = suffix_automaton.text_hashes(text, suffix_automaton.hash_table())
    monkeypatch.setattr(suffix_automaton, "HASHED_BYTES", 64)
    assert (suffix_automaton.text_hashes(text, suffix_automaton.hash_table()) == whole).all()
    assert len(whole) == len(suffix_automaton.words(text))


def test_decontaminated_copies_and_clashing_names(spark):
    """Many copies of a hit text keep their own columns, whatever these are called."""
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(i if i % 3 else None, f"see {ITEM} here " + "own words stay " * 9, f"n{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near string").withColumn("id", F.col("near"))
    docs = docs.withColumn("spans", F.lit(1)).withColumn("items", F.lit("i"))
    clean = suffix_automaton.decontaminated(docs, items)
    assert clean.columns == docs.columns
    left = clean.collect()
    assert sorted((r.near, r.id) for r in left) == sorted((n, n) for _, _, n in rows)
    assert {r.text for r in left} == {"see  here " + "own words stay " * 9}
