"""URL filters: rules indexed by their rarest literal token, fetched by the tokens of a URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligatable.llm.common import ascii_lower
from ligatable.operators.skew import ROWS_PER_TASK, salted_join
from ligatable.session import cut_lineage

#: Host and path with their verdict; the longest that fits decides.
LISTED = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: For addresses that no listed rule fits. ``*`` is any run, ``^`` a separator or the end, ``|``
#: an end of the address, ``||`` the start of a host or of a part of it, ``@@`` an exception.
PATTERNS = (
    "/wp-login.",
    "/wp-admin/",
    "/login^",
    "/logout^",
    "/signin^",
    "/signup^",
    "/register^",
    "/cart^",
    "/checkout^",
    "/search^",
    "/calendar/*/day/",
    "?replytocom=",
    "^phpsessid=",
    "^sessionid=",
    "||ads.",
    "||adserver.",
    "^casino^",
    "^porn^",
    "^viagra^",
    "^xxx^",
    "@@/search/help^",
)
#: An index of more characters than this, each rule counting some more, is not broadcast.
BROADCAST_CHARS, RULE_CHARS = 8_000_000, 100
TOKEN = "[a-z0-9]+"
#: A token of a rule that no longer run of letters and digits of an address can contain.
WHOLE_TOKEN = f"(?<=[^a-z0-9*]){TOKEN}(?=[^a-z0-9*])"


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all up to ``#`` with A-Z lower-cased; empty where there is none."""

    def found(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(url, f"://{pattern}", 1), F.lit(""))

    return ascii_lower(found("([^/?#]*)")), found("[^/?#]*([^?#]*)"), ascii_lower(found("([^#]*)"))


def address_tokens(folded: Column) -> Column:
    """The distinct tokens of an address, and the empty one, which holds the rules without a token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))))


def _table(spark: SparkSession, rows: Sequence[tuple[str, ...]], *names: str) -> DataFrame:
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def listed_rules(spark: SparkSession, listed: Sequence[tuple[str, str]] = LISTED) -> DataFrame:
    """``(rule, verdict)`` of a short list; longer ones come as a table."""
    return _table(spark, listed, "rule", "verdict")


def pattern_rules(spark: SparkSession, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """``(pattern)`` of a short list; longer ones come as a table."""
    return _table(spark, [(p,) for p in patterns], "pattern")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_/\s])", r"\\$1")


def _rules(listed: DataFrame, patterns: DataFrame) -> DataFrame:
    """Both kinds as ``kind, rule, verdict, regex`` and the tokens that any match must hold."""
    host = ascii_lower(F.substring_index("rule", "/", 1))
    rest = F.substring(F.col("rule"), F.length(host) + 1, F.length("rule"))
    # a path is matched as a prefix, so its end bounds no token
    of_list = listed.filter("rule is not null and verdict in ('allow', 'block')").select(
        F.lit("listed").alias("kind"),
        "rule",
        "verdict",
        F.concat(F.lit(r"^(?:[^/]*\.)?"), _escaped(F.concat(host, rest)), F.when(rest == "", "(?:/|$)").otherwise("")).alias("regex"),
        F.concat(F.lit("|"), host, F.when(rest == "", "|").otherwise(F.concat(ascii_lower(rest), F.lit("*")))).alias("frame"),
    )
    bare = F.regexp_replace(ascii_lower(F.col("pattern")), r"^@@", "")
    body = F.regexp_replace(F.regexp_replace(bare, r"^\|\|?", ""), r"\|$", "")
    ends = bare.endswith("|") & (body != "")
    regex = F.replace(F.replace(_escaped(body), F.lit(r"\*"), F.lit(".*")), F.lit(r"\^"), F.lit("(?:[^a-z0-9_.%-]|$)"))
    start = F.when(bare.startswith("||"), r"^(?:[^/?]*\.)?").when(bare.startswith("|"), "^").otherwise("")
    of_patterns = patterns.filter("trim(pattern) <> ''").select(
        F.lit("pattern").alias("kind"),
        F.col("pattern").alias("rule"),
        F.when(F.col("pattern").startswith("@@"), "allow").otherwise("block").alias("verdict"),
        F.concat(F.lit("(?s)"), start, regex, F.when(ends, "$").otherwise("")).alias("regex"),
        F.concat(F.when(bare.startswith("|"), "|").otherwise("*"), body, F.when(ends, "|").otherwise("*")).alias("frame"),
    )
    tokens = F.regexp_extract_all("frame", F.lit(WHOLE_TOKEN), F.lit(0))
    tokens = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("")))
    return of_list.unionByName(of_patterns).distinct().withColumn("tokens", tokens).drop("frame")


def rule_index(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Each rule under the one of its tokens that the fewest addresses hold.

    ``counts (token, rows)`` has one row per token. A rule with a token that no address
    holds cannot match and is left out.
    """
    each = rules.select("kind", "rule", "verdict", "regex", F.explode("tokens").alias("token"))
    rows = F.coalesce("rows", F.lit(0)).alias("rows")
    rarest = (
        each.join(counts, "token", "left")
        .groupBy("kind", "rule", "verdict", "regex")
        .agg(F.min(F.struct(rows, "token")).alias("rarest"))
    )
    return rarest.filter("rarest.rows > 0").select(F.col("rarest.token").alias("token"), "kind", "rule", "verdict", "regex")


def judged(
    pages: DataFrame,
    listed: DataFrame | None = None,
    patterns: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages (page_id, url)``.

    ``listed (rule, verdict)`` holds hosts with a path, ``patterns (pattern)`` filter rules;
    without them the short lists above count. A listed rule fits its host and all its
    subdomains where the path starts with the rule's, case counting in paths only. The
    longest rule decides (ties: longer host, then larger text; ``block`` before ``allow``
    where a rule has both). Where none fits, ``rule`` is null and the patterns decide, on the
    lower-cased address up to ``#``: ``block`` if one fits and no exception does, else ``allow``.

    Rules are posted under the token that the fewest addresses hold; the tokens of an address
    fetch candidates, and only those run their regular expressions. Each distinct url is
    judged once. An index of at most ``broadcast_chars`` is broadcast, a larger one joined:
    addresses with a common token, and rows with a common url, are spread. Null
    urls and urls without ``://`` have empty host and path and are allowed, unless a pattern
    fits the empty address. Repeated rows come back each; other columns are not read. Null rules,
    blank patterns and unknown verdicts are ignored. Without pages there are no rows.
    """
    spark = pages.sparkSession
    listed = listed_rules(spark) if listed is None else listed
    patterns = pattern_rules(spark) if patterns is None else patterns
    host, path, folded = address_parts(F.col("url"))
    urls = cut_lineage(pages.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("rows")))
    tokens = urls.select("url", F.explode(address_tokens(folded)).alias("token"))
    counts = cut_lineage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")))
    index = cut_lineage(rule_index(_rules(listed, patterns), counts))
    chars = index.agg(F.sum(F.length("rule") + F.length("regex") + RULE_CHARS)).first()[0]
    if (chars or 0) <= broadcast_chars:
        candidates = tokens.join(F.broadcast(index), "token")
    else:
        posted = cut_lineage(counts.join(index.select("token").distinct(), "token", "left_semi"))
        wanted = tokens.join(posted.select("token"), "token", "left_semi")
        candidates = salted_join(wanted, index, "token", counts=posted, rows_per_task=rows_per_task)
    is_listed = F.col("kind") == "listed"
    fits = candidates.withColumn("address", F.when(is_listed, F.concat(host, path)).otherwise(folded)).filter(
        F.expr("rlike(address, regex)")
    )
    size = F.length(F.substring_index("rule", "/", 1))
    longest = F.max(F.when(is_listed, F.struct(F.length("rule").alias("n"), size.alias("host"), "rule", "verdict")))

    def some(verdict: str) -> Column:
        return F.coalesce(F.bool_or(~is_listed & (F.col("verdict") == verdict)), F.lit(False))

    found = fits.groupBy("url").agg(longest.alias("best"), (some("block") & ~some("allow")).alias("blocked"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    marked = salted_join(rows, found, "url", "left", counts=urls, rows_per_task=rows_per_task)
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return marked.select(
        "page_id", host.alias("host"), path.alias("path"), "best.rule", F.coalesce("best.verdict", method).alias("verdict")
    )
