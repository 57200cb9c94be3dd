"""What the second round of advice found missing."""

import pytest
from cases import documents
from compare import differences, open_tables

import corpus_pipeline
from ligatable.llm import block_labeller, byte_langid, oracles, queries


def test_every_group_keeps_one_row_whatever_its_ids(spark, sf_dir):
    """An id on two texts, copies under other ids, and copies without any."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "xyz")
    rows = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (2, two, "en", "b", 1), (3, one, "en", "b", 1)]
    rows += [(None, three, "en", f"s{i}", 1) for i in range(5)] + [(None, one, "en", "c", 1)]
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    kept = stage(spark, documents(spark, rows), sf_dir)
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.text for r in kept.collect()) == sorted([one, two, three])
    assert stage(spark, documents(spark, []), sf_dir).count() == 0


def test_documents_stay_where_no_language_was_learned(spark):
    rows = [(i, f"some words of a clean text {i}", None, "a", 1) for i in range(9)] + [(9, "12 34", None, "a", 1), (10, None, None, "a", 1)]
    docs = documents(spark, rows)
    kept = byte_langid.known_language(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(9))


def test_many_related_languages_do_not_reject_clean_documents(spark):
    """Ten labels share all words but one, so no label gets 0.3 of a text."""
    shared = "all of these languages have the very same words in them"
    rows = [(i, f"{shared} {chr(97 + i % 10) * 6}", f"l{i % 10}", "a", 1) for i in range(200)] + [(900, "1234", "l1", "a", 1)]
    docs = documents(spark, rows)
    scores = [r.score for r in byte_langid.languages(docs).collect() if r.doc_id != 900]
    assert min(scores) < 0.3
    assert {r.doc_id for r in byte_langid.known_language(docs).collect()} == set(range(200))


def test_short_lines_and_lines_without_spaces_are_counted_in_the_pipeline(spark, sf_dir):
    """Long lines in Chinese need three sites, short lines six; shorter spread stays."""
    chinese, short, rare = "本网站的所有内容均受版权保护未经许可不得以任何形式转载", "All rights reserved.", "Read more"
    rows = [(i, f"own line number {i}\n{chinese}\n{short}" + (f"\n{rare}" if i < 5 else ""), "zh", f"s{i}", 1) for i in range(8)]
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    left = {r.doc_id: r.text.split("\n") for r in stage(spark, documents(spark, rows), sf_dir).collect()}
    assert left[0] == rows[0][1].split("\n")
    for i in range(1, 8):
        assert left[i] == [f"own line number {i}"] + ([rare] if i < 5 else [])


def test_items_without_id_are_hit_as_in_sql(spark, sf_dir, tmp_path):
    """Benchmark rows without id, and repeated texts under several ids or none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    again = items.selectExpr("if(item_id % 2 = 0, null, item_id) item_id", "text")
    more = again.unionByName(items.filter("item_id % 3 = 0").selectExpr("item_id + 1000000 item_id", "text"))
    assert more.filter("item_id is null").count() > 3
    more.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    con = open_tables(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    got = queries.op9_decontamination(spark, str(tmp_path))
    assert differences(got, con, oracles.OP9) == []


@pytest.mark.parametrize(
    "markup",
    [
        "<svg class='i'/>",
        "<object data='x' />",
        "<svg-icon></svg-icon>",
        "<title-bar></title-bar>",
        "<template-x>",
        "<svg viewBox='0 0 1 1'>",
        "<object data='y'>",
        "<iframe src='z'>",
        "<svg><title/><style/><path d='M0 0'/><text>no</text></svg>",
        "<svg><g><svg><text>no</text></svg><text>no</text></g></svg>",
        "<template><div><p>no</p></div></template>",
        "<noscript>no<img src=x></noscript>",
        "<img src=data:image/png;base64," + "A" * 5000 + ">",
        "<img alt=" + "\"a\" b='c' " * 3000 + ">",
        "<script>var a = '</p>no';</script >",
    ],
    ids=range(15),
)
def test_markup_swallows_no_text(markup):
    page = f"<body><article><p>a {markup}b</p><p>rest of article</p></article><div>after</div></body>"
    assert [b.text.replace(" ", "") for b in block_labeller.page_blocks(page)] == ["ab", "restofarticle", "after"]


def test_unclosed_elements_end_with_their_parent():
    page = "<div><p>one <object>no</p></div><p>two</p><svg>no<p>three</p></svg><object>no</object><script>no</p><p>no"
    assert [b.text for b in block_labeller.page_blocks(page)] == ["one", "two", "three"]
