import html
import math
import random
import re

import numpy as np
import pytest
from cases import documents

import corpus_pipeline
from ligatable.llm import block_labeller, permutation_index


def brute_nearest(vectors, query_id, k):
    q = vectors[query_id]
    scored = [(-float(np.dot(v, q)), i) for i, v in vectors.items() if i != query_id]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    given = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in given.collect()}
    rows = permutation_index.nearest(given, given.filter("vec_id % 20 = 0")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
    assert set(found) == {i for i in vectors if i % 20 == 0}
    recall = []
    for q, got in found.items():
        assert len(got) == 20 and q not in dict(got) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        recall.append(len({i for i, _ in got} & {i for i, _ in brute_nearest(vectors, q, 20)}) / 20)
    assert np.mean(recall) >= 0.9


def test_recall_with_several_shards_and_blocks(spark, monkeypatch):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in given.collect()}
    monkeypatch.setattr(permutation_index, "SHARD_ROWS", 700)
    monkeypatch.setattr(permutation_index, "BLOCK_QUERIES", 30)
    found = {}
    for r in permutation_index.nearest(given, given.filter("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = [len(got & {i for i, _ in brute_nearest(vectors, q, 20)}) / 20 for q, got in found.items()]
    assert len(found) == 100 and np.mean(recall) >= 0.9


def test_footrule_as_defined():
    rng = np.random.default_rng(0)
    places = np.array([rng.permutation(12)[:5] for _ in range(30)], np.int16)
    posted = permutation_index.PostingFile(np.arange(30), np.zeros((30, 2)), places, 12)
    query = rng.permutation(12)[:5].astype(np.int16)
    at = lambda p, x: list(p).index(x) if x in p else 5
    want = [sum(abs(at(query, x) - at(p, x)) for x in range(12)) for p in places]
    got = posted.footrule(query)
    assert len({w - 2 * int(g) for w, g in zip(want, got)}) == 1


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (20, [1.0, 0.0], 0),
        (1, [1.0, 0.0], 0),
        (2, [1.0, 0.0], 0),
        (2, [1.0, 0.0], 0),
        (3, [5.0, 5.0], None),
        (4, [-1.0, 0.5], 0),
        (5, None, 0),
        (6, [0.0, 0.0], 0),
        (7, [nan, 1.0], 0),
        (8, [inf, 1.0], 0),
        (9, [None, 1.0], 0),
        (10, [1.0, 2.0, 3.0], 0),
        (11, [], 0),
        (None, [1.0, 1.0], 0),
        (40, None, 0),
        (60, [0.0, 0.0], 0),
    ]
    given = table(spark, rows)
    got = permutation_index.nearest(given, given.filter("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        (20, 1, 3, 5.0),
        (20, 2, 1, 1.0),
        (20, 3, 2, 1.0),
        (20, 4, 4, -1.0),
    ]
    nothing = permutation_index.nearest(table(spark, []), table(spark, []))
    assert nothing.count() == 0 and nothing.columns == ["query_id", "rank", "vec_id", "score"]


def test_copies_tie_by_id(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(1, 900)]
    rows += [(i, [3.0] * 8, 0) for i in range(1000, 3000)]
    given = table(spark, rows)
    got = permutation_index.nearest(given, given.filter("vec_id = 2000")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1000, 1020))


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p><p>bad</p>";</script></head>
<body><header><div class="logo">Site name</div></header><nav><ul><li><a href="/x">Home</a><li><a href="/y">About us</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First   paragraph
with <b>bold</b> &eacute;text.<p>Second one &lt;here&gt;.<!-- no --><script>x()</script></p>
<aside class="related">Read more</aside><p>Third "quoted" <a href="a>b">link</a> end.</p></article>
<div id="comments"><p>I disagree with all of it.</p></div><form><label>Mail</label></form><footer>&copy; 2020 all</footer>"""


def test_blocks_of_a_page():
    blocks = block_labeller.page_blocks(PAGE)
    labels = block_labeller.weak_labels(blocks)
    assert [b.text for b, y in zip(blocks, labels) if y] == [
        "Head & line",
        "First paragraph with bold étext.",
        "Second one <here>.",
        'Third "quoted" link end.',
    ]
    assert [b.text for b, y in zip(blocks, labels) if not y] == [
        "Site name",
        "Home",
        "About us",
        "We use cookies.",
        "Read more",
        "I disagree with all of it.",
        "Mail",
        "© 2020 all",
    ]
    assert all(b.linked == len(b.text) for b in blocks if b.text in ("Home", "About us"))


def truth(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_text_of_pages_it_did_not_learn_from(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labeller = block_labeller.learn(given.filter("page_id % 2 = 0"))
    rows = block_labeller.main_text(given.filter("page_id % 2 = 1"), labeller).collect()
    pages = dict(given.select("page_id", "html").collect())
    right = [r.text == truth(pages[r.page_id]) for r in rows]
    assert len(rows) == 125 and np.mean(right) > 0.97
    assert all(r.n_chars == len(r.text) for r in rows)


def test_network_reads_the_context():
    """Equal blocks are told apart by their neighbours, in both directions."""
    rng = np.random.default_rng(0)
    width = block_labeller.PATH_BUCKETS + block_labeller.WORD_BUCKETS + block_labeller.NUMBERS
    same, before, after = (rng.normal(size=width).astype(np.float32) for _ in range(3))
    pages = [np.stack([same, before, same]), np.stack([same, after, same])] * 40
    labels = [np.array([1, 0, 0], np.float32), np.array([0, 0, 1], np.float32)] * 40
    labeller = block_labeller.Labeller()
    labeller.train(pages, labels, epochs=40)
    one, two = labeller.probabilities(pages[:2])
    assert (one > 0.5).tolist() == [True, False, False] and (two > 0.5).tolist() == [False, False, True]


def test_page_cases(spark):
    rows = [
        (1, "u", PAGE),
        (1, "u", PAGE),
        (2, None, None),
        (3, "u", ""),
        (None, "u", "<article><p>Words without an id, a full sentence of them.</p></article>"),
        (4, "u", "plain text without any markup, a whole sentence that goes on for a while"),
        (5, "u", "<" * 3000),
        (6, "u", "<div" + " a='x" * 2000),
        (7, "u", "<p>" + "word " * 40_000),
        (8, "u", "<script>never closed"),
        (9, "u", "".join(f"<p>para {i}</p>" for i in range(5000))),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 row", "2 text", "3 n_chars")
    got = block_labeller.main_text(pages).collect()
    assert len(got) == len(rows)
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3, 8))
    assert block_labeller.main_text(pages.limit(0)).count() == 0


def test_stages_take_awkward_documents(spark, sf_dir):
    for rows in (None, []):
        docs = documents(spark) if rows is None else documents(spark, rows)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns


def test_pipeline_does_what_the_stages_say(spark, tmp_path):
    """Planted: no language, boilerplate, near copies and a benchmark passage."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    own = docs.orderBy("doc_id").limit(5).collect()
    plain = next(r.text for r in own if r.text and len(r.text) > 300)
    line = "this very line stands on many different sites of the web"
    more = [(90_000, "1234 5678", "en", "p", 9), (90_001, passage + " tail", "en", "p", 9), (90_002, "  " + plain.replace(" ", "  "), "en", "p", 9)]
    more += [(90_010 + i, f"{plain[i * 7 : i * 7 + 90]} own words {i}\n{line}", "en", f"q{i}", 9) for i in range(4)]
    planted = docs.unionByName(spark.createDataFrame(more, docs.schema))
    planted.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = planted
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, str(tmp_path)).collect(), left.schema)
        seen.append({r.doc_id: r.text for r in left.collect()})
    assert 90_000 not in seen[0] and len(seen[0]) >= planted.count() - 5
    assert sum(line in (t or "") for t in seen[1].values()) == 1 and len(seen[1]) == len(seen[0])
    assert 90_002 not in seen[2] and len(seen[2]) < len(seen[1])
    assert passage[:60] not in (seen[3].get(90_001) or "")
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} <= set(seen[3]) and all(not math.isnan(r.n_chars) for r in whole)
