import math
import random
from collections import Counter

import numpy as np
import pytest
from cases import EXTRA, LONG, ROWS, TEXT, documents, words
from zlib import crc32

from ligatable.llm import byte_langid, common, gated_lm, gru, quality


def numeric(loss, array, at, eps=1e-2):
    kept = array[at]
    array[at] = kept + eps
    up = loss()
    array[at] = kept - eps
    down = loss()
    array[at] = kept
    return (up - down) / (2 * eps)


def close(got, want):
    assert got == pytest.approx(want, rel=0.05, abs=3e-3)


def test_layer_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.new_layer(rng, 5, 4).items()}
    ids = rng.integers(0, 5, (6, 3))
    keep = (rng.random((6, 3)) < 0.8).astype(float)
    weight = rng.normal(size=(6, 3, 4))
    loss = lambda: float((gru.forward(p, ids, keep, np.zeros((3, 4))) * weight).sum())
    tape = []
    gru.forward(p, ids, keep, np.zeros((3, 4)), tape)
    grads = gru.backward(p, ids, keep, tape, weight)
    for name in p:
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            close(grads[name][at], numeric(loss, p[name], at, 1e-3))


def small_vocabulary(texts):
    counts = Counter(w for t in texts for w in gated_lm.tokens(t.encode()))
    ends = counts.pop(gated_lm.END)
    top = [gated_lm.END, *(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])))]
    number = np.array([ends, *(counts[w] for w in top[1:])])
    size = min(20, len(top))
    rare = np.array([gated_lm.rare_class(w) for w in top])
    n, v = np.zeros(gated_lm.RARE_CLASSES), np.zeros(gated_lm.RARE_CLASSES)
    np.add.at(n, rare[size:], number[size:])
    np.add.at(v, rare[size:], 1)
    codes = np.where(np.arange(len(top)) < size, np.arange(len(top)), size + rare)
    return gated_lm.Vocabulary(
        b" ".join(top), codes.astype(np.int32), number, size, int(number.sum()), len(top), -np.log(n + v + 1)
    )


TEXTS = ["a b c a b c d e", "the cat sat on the mat", "a b the cat", "unknownish wording here"]


def test_model_is_a_distribution_over_the_vocabulary():
    """Given any history, probabilities of all known words and one new word a class sum to 1."""
    vocab = small_vocabulary(TEXTS)
    model = gated_lm.Model(vocab)
    history = [1, 3, vocab.size + 4]
    total = 0.0
    known_mass = np.zeros(gated_lm.RARE_CLASSES)
    for code, n in zip(vocab.codes, vocab.counts):
        if code >= vocab.size:
            known_mass[code - vocab.size] += (n + 1) * math.exp(vocab.rare_log[code - vocab.size])
    before = model.score([np.array(history)])[0]
    for code in range(vocab.size + gated_lm.RARE_CLASSES):
        p = math.exp(model.score([np.array([*history, code])])[0] - before)
        if code >= vocab.size:
            c = code - vocab.size
            p *= known_mass[c] + math.exp(vocab.rare_log[c])
        total += p
    assert total == pytest.approx(1, abs=1e-4)


def test_state_is_carried_across_windows_and_documents_stand_alone(monkeypatch):
    vocab = small_vocabulary(TEXTS)
    model = gated_lm.Model(vocab)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, vocab.size + gated_lm.RARE_CLASSES, n) for n in (1, 7, 90, 33, 64, 200)]
    together = model.score(docs, lanes=4)
    alone = [model.score([d])[0] for d in docs]
    monkeypatch.setattr(gated_lm, "WINDOW", 1000)
    at_once = model.score(docs)
    assert together == pytest.approx(alone, rel=1e-4) and together == pytest.approx(at_once, rel=1e-4)


def test_output_gradients():
    vocab = small_vocabulary(TEXTS)
    model = gated_lm.Model(vocab)
    for k in model.out:
        model.out[k] = model.out[k].astype(np.float64)
    rng = np.random.default_rng(2)
    states, codes = rng.normal(size=(30, gated_lm.HIDDEN)), rng.integers(0, vocab.size + gated_lm.RARE_CLASSES, 30)
    loss = lambda: -float(model.outputs(states, codes)[0].sum())
    grads = {k: np.zeros_like(v) for k, v in model.out.items()}
    _, d = model.outputs(states, codes, grads)
    for name in model.out:
        for _ in range(10):
            at = tuple(rng.integers(0, n) for n in model.out[name].shape)
            close(grads[name][at], numeric(loss, model.out[name], at, 1e-3))
    for _ in range(10):
        at = tuple(rng.integers(0, n) for n in states.shape)
        close(d[at], numeric(loss, states, at, 1e-3))


def test_training_learns_an_order():
    text = "one two three four five six seven eight"
    vocab = small_vocabulary([text] * 50)
    index = vocab.index()
    docs = [gated_lm._codes(index, vocab, gated_lm.tokens(text.encode()))[1]] * 200
    model = gated_lm.Model(vocab)
    before = model.score(docs[:1])[0]
    for _ in range(10):
        model.train(docs, 0.02)
    assert model.score(docs[:1])[0] > before / 3


def test_document_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in gated_lm.document_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    tokens = {r.doc_id: [*words(r.text), None] for r in docs}
    counts = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    assert set(rows) == set(tokens)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(t), n)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0


def test_model_beats_the_counts_on_held_out_documents(spark):
    rows = gated_lm.document_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    gain = [(r.score - r.base_score) / r.n_tokens for r in rows.collect()]
    assert np.mean(gain) > 0.02


def test_scores_do_not_depend_on_the_partitions(spark, sf_dir, monkeypatch):
    """Several copies, long documents in segments, and rows that repeat: one model however they lie."""
    monkeypatch.setattr(gated_lm, "COPY_TOKENS", 8192)
    monkeypatch.setattr(gated_lm, "SEGMENT", 500)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1))
    found = []
    for n in (1, 4, 16):
        rows = gated_lm.document_scores(docs.repartition(n)).collect()
        found.append(sorted((r.doc_id, r.n_tokens, r.score) for r in rows))
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert [r[2] for r in other] == pytest.approx([r[2] for r in found[0]], rel=1e-6)


def test_state_ends_with_a_document_in_training():
    """Two documents behind each other train like the same two in lanes of their own."""
    vocab = small_vocabulary(TEXTS)
    rng = np.random.default_rng(3)
    p = gated_lm.Model(vocab).layer
    ids = rng.integers(0, vocab.size, (6, 1))
    go = np.array([1, 1, 0, 1, 1, 0], np.float32)[:, None]
    zero = np.zeros((1, gated_lm.HIDDEN), np.float32)
    tape, keep = [], np.ones((6, 1), np.float32)
    after = gru.forward(p, ids, keep, zero, tape, go)
    pair = np.concatenate((ids[:3], ids[3:]), axis=1)
    apart_tape, stop = [], np.repeat(go[:3], 2, axis=1)
    apart = gru.forward(p, pair, np.ones((3, 2), np.float32), np.repeat(zero, 2, axis=0), apart_tape, stop)
    assert after[:3, 0] == pytest.approx(apart[:, 0]) and after[3:, 0] == pytest.approx(apart[:, 1])
    weight = rng.normal(size=after.shape).astype(np.float32)
    whole = gru.backward(p, ids, keep, tape, weight, go)
    split = np.concatenate((weight[:3], weight[3:]), axis=1)
    parts = gru.backward(p, pair, np.ones((3, 2), np.float32), apart_tape, split, stop)
    for name in whole:
        assert whole[name] == pytest.approx(parts[name], abs=1e-5)


def test_counts_do_not_depend_on_the_list(spark, sf_dir, monkeypatch):
    """With few listed words, the joined counts give the same base score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: (r.base_score, r.n_known) for r in gated_lm.document_scores(docs).collect()}
    monkeypatch.setattr(gated_lm, "LISTED", 3000)
    got = {r.doc_id: (r.base_score, r.n_known) for r in gated_lm.document_scores(docs).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_all_counts_may_tie_at_the_cut(spark, monkeypatch):
    """No word is listed then, but for the end; all counts are joined."""
    monkeypatch.setattr(gated_lm, "LISTED", 5)
    ids = [i for i in range(60) if crc32(str(i).encode()) % 7 != 2][:20]
    docs = spark.createDataFrame([(i, f"only{i} here{i}") for i in ids], "doc_id long, text string")
    n, v = 60, 41
    for r in gated_lm.document_scores(docs).collect():
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, 3, 3)
        assert r.base_score == pytest.approx(math.log10(4 * 21) - 3 * math.log10(n + v + 1))
        assert math.isfinite(r.score)


def test_score_cases(spark):
    rows = gated_lm.document_scores(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    assert sorted(r.n_tokens for r in rows if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    assert [r.n_tokens for r in rows if r.doc_id == 5] == [len(LONG.split()) + 1]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert gated_lm.document_scores(documents(spark, [])).count() == 0
    only_held = [(i, TEXT, "en", "a", 1) for i in range(40) if crc32(str(i).encode()) % 7 == 2]
    alone = gated_lm.document_scores(documents(spark, only_held)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in alone} == {(0, 0, 0.0)}


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = dict(docs.select("doc_id", "lang").collect())
    rows = byte_langid.languages(docs).collect()
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def test_labels_do_not_depend_on_the_batch():
    labeller = byte_langid.Labeller(["a", "b", "c"])
    some = [b"x", b"hello", "ünïcode".encode(), b"12", b"q" * byte_langid.RUN, b"--"]
    together = labeller.pooled(some)
    alone = np.concatenate([labeller.pooled([w]) for w in some])
    assert together == pytest.approx(alone, abs=1e-5)
    assert together[:, -1].tolist() == [1, 5, 9, 0, byte_langid.RUN, 0]
    assert together[:, :-1].sum(axis=1) == pytest.approx(together[:, -1], abs=1e-4)


def test_language_cases(spark):
    rows = [*ROWS, (60, "1234 -- 56.78", "en", "a", 1), (61, "..." * 10, None, "a", 1)]
    found = byte_langid.languages(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r for r in found}
    for i in (2, 3, 4, 60, 61):
        assert (of[i].lang_pred, of[i].score) == ("und", 0.0)
    assert all(of[i].lang_pred in ("en", "de") for i in (1, 5, 6, 7, 8))
    kept = byte_langid.known_language(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {2, 3, 4, 60, 61} and {1, 5, 8} <= ids
    assert byte_langid.languages(documents(spark, [])).count() == 0
    untold = documents(spark, [(i, TEXT, None, "a", 1) for i in range(3)])
    assert {r.lang_pred for r in byte_langid.languages(untold).collect()} == {"und"}


def brute_ratio(text, target, raw):
    found = Counter(quality.buckets(text.encode(), quality.hash_table(), quality.BUCKET_BITS).tolist())
    m = 1 << quality.BUCKET_BITS
    t, r = sum(target.values()) + m, sum(raw.values()) + m
    return sum(n * (math.log((target[b] + 1) / t) - math.log((raw[b] + 1) / r)) for b, n in found.items())


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_importance_as_counted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in quality.importance_sample(docs, known).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    good = {r.doc_id for r in known.collect() if r.quality == 1 and r.toxic == 0}
    target, raw = Counter(), Counter()
    for i, t in texts.items():
        found = quality.buckets(t.encode(), quality.hash_table(), quality.BUCKET_BITS).tolist()
        assert rows[i].n_grams == len(found) == max(0, 2 * len(t.split()) - 1)
        raw.update(found)
        if i in good:
            target.update(found)
    for i in list(texts)[:40]:
        assert rows[i].log_ratio == pytest.approx(brute_ratio(texts[i], target, raw))
    k = round(len(good) / known.count() * len(texts))
    best = sorted(rows.values(), key=lambda r: -r.gumbel_key)
    assert {r.doc_id for r in best[:k]} == {r.doc_id for r in rows.values() if r.selected}
    bad = [rows[r.doc_id].selected for r in known.collect() if r.quality == 0]
    fine = [rows[i].selected for i in good]
    assert np.mean(fine) > 0.9 and np.mean(bad) < 0.2


def test_gumbel_draws_by_importance(spark):
    """Of documents of one importance, a share is drawn as if at random; ratios move it."""
    rows = spark.range(4000).selectExpr("id doc_id", "'same words' text")
    drawn = quality.importance_sample(rows, labels(spark, []), share=0.25).filter("selected").select("doc_id").collect()
    assert len(drawn) == 1000 and 400 < sum(r.doc_id < 2000 for r in drawn) < 600


@pytest.mark.parametrize("k", [1, 2, 5000, 9999, 10_000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-7), 3.5, -1e9 * rng.random()]) for _ in range(10_000)]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    assert common.kth_largest(table, "x", k) == sorted(values, reverse=True)[k - 1]


def test_quality_cases(spark):
    known = labels(spark, [(1, 1, 0), (1, 1, 0), (8, 1, None), (5, 0, 0), (6, 1, 1), (None, 1, 0), (7, None, 0)])
    rows = quality.importance_sample(documents(spark), known).collect()
    assert len(rows) == len(ROWS)
    assert all(r.log_ratio == 0 and r.n_grams == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert all(math.isfinite(r.gumbel_key) for r in rows)
    same = [r.selected for r in rows if r.doc_id == 1]
    assert same == [same[0]] * 2
    assert all(r.selected for r in quality.importance_sample(documents(spark), labels(spark, [])).collect())
    assert quality.importance_sample(documents(spark, []), known).count() == 0
    assert len(EXTRA) > 0
