import random
import re
import time

import numpy as np
import pytest
import xxhash
from cases import EXTRA, ROWS, TEXT, documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from ligatable.llm import ball_simhash, components, line_spread


def brute_print(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """Smallest member's position by position, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(ball_simhash.near_duplicates(docs).collect())
    texts = dict(docs.select("doc_id", "text").collect())
    prints = [brute_print(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [format(p, "016x") for p in prints]
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in brute_components(prints)]


@pytest.mark.parametrize("seed", range(3))
def test_balls_lose_no_link(spark, seed):
    """Chains and clusters at distances around three, with all radii and parities."""
    rng = random.Random(seed)
    prints = set()
    for _ in range(30):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            prints.add(p)
            for _ in range(rng.choice([1, 2, 3, 3, 3, 4, 5])):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = ball_simhash.ball_links(ball_simhash.crowded(table, 6))
    labels = {r.node: r.label for r in components.connected_components(links).collect()}
    got = [labels.get(p, p) for p in signed]
    want = brute_components(prints)
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


def test_ball_masks_meet_at_every_distance():
    even, odd = map(set, ball_simhash.ball_masks())
    rng = random.Random(1)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randrange(4))
        d = sum(1 << b for b in bits)
        x = rng.getrandbits(64)
        y = x ^ d
        mine = {x ^ m for m in (even if x.bit_count() % 2 == 0 else odd)}
        theirs = {y ^ m for m in (even if y.bit_count() % 2 == 0 else odd)}
        assert any((z ^ x).bit_count() + (z ^ y).bit_count() <= 3 for z in mine & theirs)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs, "a long, b long")
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert dict(components.connected_components(links).collect()) == {i: find(i) for i in list(root)}


def test_simhash_cases(spark):
    rows = ball_simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 4, None} and {r.component_id for r in zero} == {2}
    assert of[1].component_id == 1
    same = [r for r in rows if r.fingerprint == of[1].fingerprint]
    assert {r.component_id for r in same} == {1} and len(same) == 3
    kept = ball_simhash.one_per_component(documents(spark))
    assert kept.columns == documents(spark).columns
    left = kept.collect()
    assert sorted(r.doc_id for r in left) == sorted({r.component_id for r in rows})
    assert len({(r.doc_id, r.text) for r in left}) == len(left)


def test_a_component_keeps_one_row_whatever_its_ids(spark):
    """An id on two texts, copies under other ids, copies without any, and repeated rows."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "xyz")
    rows = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (2, two, "en", "b", 1), (3, one, "en", "b", 1)]
    rows += [(None, three, "en", f"s{i}", 1) for i in range(5)] + [(None, one, "en", "c", 1)] + [(5, "", "en", "a", 0)] * 3
    kept = ball_simhash.one_per_component(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, three), (1, one), (1, two), (5, "")]


def test_simhash_without_documents(spark):
    assert ball_simhash.near_duplicates(documents(spark, [])).count() == 0
    assert ball_simhash.one_per_component(documents(spark, [])).count() == 0


FIRST, OTHER = "one two three four five six", "seven eight nine ten eleven twelve"


def test_lines_on_many_sites_stay_once(spark):
    rows = [(i, f"own line of document number {i} here\n {FIRST}\t\nshort one", "en", f"s{i % 4}", 1) for i in range(9)]
    rows += [(20 + i, OTHER, "en", f"s{i % 2}", 1) for i in range(5)]
    done = {r.row.doc_id: r for r in line_spread.without_boilerplate(documents(spark, rows)).collect()}
    assert done[0].n_removed == 0 and done[0].text == rows[0][1]
    for i in range(1, 9):
        assert done[i].text == f"own line of document number {i} here\nshort one" and done[i].n_removed == 1
    assert all(done[20 + i].text == OTHER for i in range(5))


@pytest.mark.parametrize("sites,gone", [(2, False), (3, True), (6, True), (7, True), (40, True)])
def test_spread_by_estimate_and_by_count(spark, sites, gone):
    rows = [(i, FIRST, "en", f"s{i % sites}", 1) for i in range(80)]
    done = line_spread.without_boilerplate(documents(spark, rows)).collect()
    assert sum(r.n_removed for r in done) == (79 if gone else 0)


def test_line_cases(spark):
    docs = documents(spark)
    done = line_spread.deduplicated_lines(docs)
    assert done.columns == docs.columns and done.count() == len(ROWS)
    given = sorted(map(str, docs.collect()))
    assert sorted(map(str, done.collect())) != [] and len(given) == done.count()
    assert [r.text for r in done.collect() if r.doc_id == 2] == [None]
    assert line_spread.without_boilerplate(documents(spark, [])).count() == 0
    # the text of 1, None and 8 differs by a mark only; three sites share none but TEXT
    assert TEXT in [r.text for r in done.collect()]


def test_many_removed_lines_of_one_text_take_linear_time(spark):
    """The work for a text grows with its lines, not with lines times removed lines."""
    line = "this line stands on very many different sites"
    long = [(1, "\n".join([line, "own"] * 100_000), "en", "a", 1)]
    rows = long + [(i, line, "en", f"s{i}", 1) for i in range(2, 8)]
    start = time.monotonic()
    done = {r.row.doc_id: r for r in line_spread.without_boilerplate(documents(spark, rows)).collect()}
    assert time.monotonic() - start < 60
    assert done[1].text == line + "\n" + "\n".join(["own"] * 100_000)
    assert (done[1].n_lines, done[1].n_removed, done[2].text) == (200_000, 99_999, "")


def test_native_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = line_spread.without_boilerplate(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
    assert len(EXTRA) > 0
