"""Cross-site boilerplate lines, by the number of distinct sites of each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligatable.session import cut_lineage

#: Registers of a sketch, as a power of two; its standard error is about 1.6 %.
LG_K = 12
#: A line is hot from one in so many places on.
HOT_SHARE = 1000
#: A line of so many characters is long, however few runs without white space it has.
LONG_CHARS = 20
#: Sites that make a short line boilerplate where short lines are counted: twice the usual number.
SHORT_SITES = 6


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(*columns: Column | str) -> tuple[Column, Column]:
    """128 bits of hash as two longs."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def _counted_lines(docs: DataFrame, min_words: int, short_sites: int | None) -> DataFrame:
    """One row a line that is counted: its key, place and site, and whether it is short.

    Without ``short_sites`` lines of fewer than ``min_words`` words are not counted. With
    it all are, and lines of so few words and fewer than ``LONG_CHARS`` characters are short.
    """
    d1, d2 = _key("doc_id", "text")
    # the hashes of the text belong below the generator, which would ask for them once a line
    keyed = docs.select("doc_id", "site", d1.alias("d1"), d2.alias("d2"), "text")
    exploded = keyed.select("doc_id", "site", "d1", "d2", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    h1, h2 = _key("line")
    wordy = F.col("line").rlike(rf"^(?:\S+\s+){{{min_words - 1}}}\S")
    short = F.lit(False) if short_sites is None else ~wordy & (F.length("line") < LONG_CHARS)
    return (
        exploded.withColumn("line", line)
        .filter(wordy if short_sites is None else F.col("line") != "")
        .select("doc_id", "d1", "d2", "pos", "site", h1.alias("h1"), h2.alias("h2"), short.alias("short"))
    )


def boilerplate(docs: DataFrame, min_sites: int, min_words: int, short_sites: int | None = None) -> DataFrame:
    """``(h1, h2, first, n)`` of the lines on at least ``min_sites`` distinct sites.

    Short lines, if ``short_sites`` is given, need at least that many.

    Each line hash gets a HyperLogLog sketch of its sites; sketches merge by
    aggregation, partly before the shuffle, so a line that a third of all documents
    share costs one row a task. Estimates below half the threshold are dropped and
    those above twice it taken; lines in between get an exact distinct count.
    """
    lines = _counted_lines(docs, min_words, short_sites)
    least = F.when(F.col("short"), F.lit(short_sites)).otherwise(F.lit(min_sites)).alias("least")
    place = F.struct("doc_id", "d1", "d2", "pos")
    spread = (
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_agg("site", LG_K).alias("sketch"),
            F.min(place).alias("first"),
            F.count("*").alias("n"),
            F.max("short").alias("short"),
        )
        .select("h1", "h2", "first", "n", F.hll_sketch_estimate("sketch").alias("sites"), least)
        .filter(F.col("sites") >= F.col("least") / 2)
    )
    sure = spread.filter(F.col("sites") > 2 * F.col("least")).select("h1", "h2", "first", "n")
    near = spread.filter(F.col("sites") <= 2 * F.col("least")).select("h1", "h2", "first", "n", "least")
    exact = (
        lines.select("h1", "h2", "site")
        .distinct()
        .join(near.select("h1", "h2", "least"), ["h1", "h2"])
        .groupBy("h1", "h2", "least")
        .agg(F.count("*").alias("sites"))
        .filter(F.col("sites") >= F.col("least"))
    )
    return sure.unionByName(near.drop("least").join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def _places_to_clear(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``(d1, d2, gone)``: the line numbers that go, by document.

    Lines with a thousandth or more of all places of ``found`` are at most a thousand:
    they are broadcast, and their places dealt by document, so no task gets all places
    of a frequent line. The others are joined by their hash.
    """
    found = cut_lineage(found)
    total = found.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * HOT_SHARE >= total
    hot = F.broadcast(found.filter(frequent).select("h1", "h2", F.col("first").alias("hot_first")))
    cold = found.filter(~frequent).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("first").alias("cold_first"))
    is_hot = F.col("hot_first").isNotNull()
    dealt = lines.join(hot, ["h1", "h2"], "left").select(
        "d1",
        "d2",
        "pos",
        "hot_first",
        F.when(is_hot, F.col("d1")).otherwise(F.col("h1")).alias("k1"),
        F.when(is_hot, F.col("d2")).otherwise(F.col("h2")).alias("k2"),
    )
    first = F.coalesce("hot_first", "cold_first")
    is_first = (first["d1"] == F.col("d1")) & (first["d2"] == F.col("d2")) & (first["pos"] == F.col("pos"))
    # null where the line is not among those found
    return dealt.join(cold, ["k1", "k2"], "left").filter(~is_first).groupBy("d1", "d2").agg(F.collect_set("pos").alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers, in time linear in its lines.

    The numbers that stay come from a set difference, which hashes and keeps the order. The
    struct is there for its lines to be split once, not once for each line.
    """
    lines = _lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.transform(
        F.array(F.struct(lines.alias("lines"), stay.alias("stay"))),
        lambda s: F.array_join(F.transform(s["stay"], lambda i: F.get(s["lines"], i)), "\n"),
    )
    return F.get(left, F.lit(0))


def without_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = 3, min_words: int = 5, short_sites: int | None = None
) -> DataFrame:
    """``row`` (all columns), ``text`` (what is left of it), ``n_lines``, ``n_removed``.

    ``docs`` needs ``doc_id, text`` and the ``site`` column; null sites are one site. A
    line is compared without leading and trailing blanks. Lines of fewer than
    ``min_words`` words are never removed, unless ``short_sites`` is given: then every
    line that is not empty is counted, one of ``LONG_CHARS`` characters is as good as one
    of ``min_words`` words, and shorter ones need ``short_sites`` sites. A line on ``min_sites`` distinct sites or more
    stays where it occurs first, by ``doc_id`` (null first) and line number, so that no
    content is lost, and goes everywhere else. Rows that are equal in ``doc_id`` and
    ``text`` are one document to this. A null text stays null and has no lines; a text
    may become empty. Lines are separated by ``\\n``; kept lines are not changed.
    """
    whole = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("site"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"),
    )
    slim = whole.select("doc_id", "text", "site")
    found = boilerplate(slim, min_sites, min_words, short_sites)
    removed = _places_to_clear(_counted_lines(slim, min_words, short_sites), found)
    d1, d2 = _key("doc_id", "text")
    joined = whole.withColumn("d1", d1).withColumn("d2", d2).join(removed, ["d1", "d2"], "left")
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias("text"),
        F.coalesce(F.array_size(_lines(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def deduplicated_lines(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the lines that ``without_boilerplate`` removes; no row goes."""
    done = without_boilerplate(docs, **options)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
    return done.select(
        *(
            (
                F.col("text")
                if c == "text"
                else F.coalesce(length, F.col("row.n_chars"))
                if c == "n_chars"
                else F.col(f"row.`{c}`")
            ).alias(c)
            for c in docs.columns
        )
    )
