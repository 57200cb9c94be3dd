import random
import re
from collections import Counter

import pytest
from compare import differences, open_tables

from ligatable.llm import oracles, queries, url_rules

URLS = [
    None,
    "",
    "no address",
    "https://",
    "https:///",
    "https://com",
    "https://com/",
    "https://A.Example.COM/en/x",
    "https://a.example.com/EN/x",
    "https://www.example.com/en/",
    "https://m.www.example.com/en/?q=1",
    "https://notexample.com/en/",
    "https://xcom/en/",
    "http://a.net/es/1#top",
    "http://a.net/esp/1",
    "http://a.net?x=/es/",
    "http://a.net/?u=://b.com/en/",
    "http://a.org/Login",
    "http://a.org/login.html",
    "http://a.org/a/search?x",
    "http://a.org/search/help",
    "http://a.org/search/help/login",
    "http://a.org/x?replytocom=3",
    "http://a.org/x#?replytocom=3",
    "http://a.org/calendar/1/2/day/",
    "http://a.org/calendarx/1/2/day/",
    "http://ads.a.org/",
    "http://x.adserver.org/",
    "http://loads.org/",
    "http://a.org/best-casino-4u",
    "http://a.org/best_casino_4u",
    "http://a.org/xxx",
    "ftp://user@a.net:21/fr/é\n?x",
    "http://bücher.com/x",
    "http://a.org/" + "long/" * 20_000 + "login",
    "http://a.org/\nx/cart",
]


def pages(spark, urls=URLS):
    rows = [(i if i % 7 else None, u) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 rule", "2 host", "3 rows", "4 token")


def in_sql(spark, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    con = open_tables("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    return con


def test_same_as_sql(spark, sf_dir):
    assert differences(queries.op13_url_filter(spark, sf_dir), open_tables(sf_dir), oracles.OP13) == []


@pytest.mark.parametrize("limits", [(10**6, 10**7), (3, 0)], ids=["broadcast", "salted"])
def test_awkward_urls_as_in_sql(spark, tmp_path, limits):
    """Nulls, no host, ports, cases, repeated rows and a url that holds a third of the rows."""
    given = pages(spark, URLS * 2 + ["http://a.net/es/hot"] * len(URLS))
    con = in_sql(spark, tmp_path, given)
    got = url_rules.judged(spark.read.parquet(f"{tmp_path}/pages.parquet"), rows_per_task=limits[0], broadcast_chars=limits[1])
    assert differences(got, con, oracles.OP13) == []


def fits(rule, url):
    """A filter rule by the meaning of its signs, character by character."""
    text = re.search("://([^#]*)", url)[1].lower()
    body = rule.removeprefix("@@").removeprefix("||").removeprefix("|").removesuffix("|")
    ends = rule.endswith("|")
    starts = range(len(text) + 1)
    if rule.removeprefix("@@").startswith("||"):
        head = re.match("[^/?]*", text).end()
        starts = [i for i in range(head + 1) if i == 0 or text[i - 1] == "."]
    elif rule.removeprefix("@@").startswith("|"):
        starts = [0]

    def at(i, k):
        if k == len(body):
            return not ends or i == len(text)
        if body[k] == "*":
            return any(at(j, k + 1) for j in range(i, len(text) + 1))
        if body[k] == "^":
            return (i == len(text) and at(i, k + 1)) or (i < len(text) and not re.match("[a-z0-9_.%-]", text[i]) and at(i + 1, k + 1))
        return i < len(text) and text[i] == body[k] and at(i + 1, k + 1)

    return any(at(i, 0) for i in starts)


@pytest.mark.parametrize("limits", [(10**6, 10**7), (5, 0)], ids=["broadcast", "salted"])
def test_random_patterns_equal_trying_each(spark, limits):
    rng = random.Random(2)
    parts = ["a", "b", "ab", "abc", "c1", "-", ".", "/", "_", "=", "+", "("]
    patterns = {
        rng.choice(["", "", "|", "||", "@@", "@@||"])
        + "".join(rng.choice(["*", "^", *parts, *parts]) for _ in range(rng.randrange(2, 7)))
        + rng.choice(["", "", "|", "^"])
        for _ in range(150)
    }
    patterns = sorted(p for p in patterns if p.strip("@|*") and not re.fullmatch(r"(@@)?\|*[*^]+\|?", p))
    urls = ["http://" + "".join(rng.choice(parts[:5]) + rng.choice(["/", ".", "-", "/", "?", "("]) for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    got = url_rules.judged(
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"),
        spark.createDataFrame([], "rule string, verdict string"),
        spark.createDataFrame([(p,) for p in patterns] + [(None,), (" ",)], "pattern string"),
        rows_per_task=limits[0],
        broadcast_chars=limits[1],
    ).collect()
    want = {}
    for i, u in enumerate(urls):
        hit = {p.startswith("@@") for p in patterns if fits(p, u)}
        want[i] = "block" if hit == {False} else "allow"
    assert {r.page_id: r.verdict for r in got} == want and all(r.rule is None for r in got)
    assert min(Counter(want.values()).values()) > 5


def test_listed_rules_of_any_form(spark):
    listed = [("a.org", "block"), ("b.a.org/x+y", "allow"), ("a.org", "allow"), (None, "block"), ("c.org/", "perhaps"), ("B.A.org/x+y/*", "block")]
    urls = ["http://a.org", "http://z.a.org/x", "http://b.a.org/x+yz", "http://b.a.org/xxy", "http://c.org/", "http://b.a.org/x+y/*1", "http://aa.org/"]
    got = url_rules.judged(pages(spark, urls), spark.createDataFrame(listed, "rule string, verdict string")).collect()
    assert sorted((r.host + r.path, r.rule or "", r.verdict) for r in got) == sorted(
        [
            ("a.org", "a.org", "block"),
            ("z.a.org/x", "a.org", "block"),
            ("b.a.org/x+yz", "b.a.org/x+y", "allow"),
            ("b.a.org/xxy", "a.org", "block"),
            ("c.org/", "", "allow"),
            ("b.a.org/x+y/*1", "B.A.org/x+y/*", "block"),
            ("aa.org/", "", "allow"),
        ]
    )


def test_rules_stand_under_their_rarest_token(spark):
    rules = url_rules._rules(url_rules.listed_rules(spark), url_rules.pattern_rules(spark))
    counts = spark.createDataFrame([("com", 9), ("example", 5), ("www", 2), ("en", 7), ("net", 3), ("login", 1)], "token string, rows long")
    index = {r.rule: r.token for r in url_rules.rule_index(rules, counts).collect()}
    assert index["com/"] == "com" and index["example.com/en/"] == "example" and index["www.example.com/en/"] == "www"
    assert index["/login^"] == "login" and "/cart^" not in index and "net/es/" not in index


def test_no_pages(spark):
    got = url_rules.judged(pages(spark, []))
    assert got.count() == 0 and got.columns == ["page_id", "host", "path", "rule", "verdict"]


def test_only_native_operators(spark, sf_dir):
    plan = queries.op13_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
