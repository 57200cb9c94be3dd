"""From raw measurements to one row per drug-target pair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligatable.functions import scores
from ligatable.sources.registry import SOURCES, AffinitySource, concentration_names, source_names

BITS = 62


def canonical_affinity(df: DataFrame, drug_col: str, target_col: str, score_col: str, *keep: str) -> DataFrame:
    """Ids as strings and the score as a double; text that is no number becomes null."""
    return df.select(
        F.col(drug_col).cast("string").alias("DrugID"),
        F.col(target_col).cast("string").alias("TargetID"),
        F.col(score_col).try_cast("double").alias("RawScore"),
        *keep,
    )


#: What a raw row may break, in the order in which it is tested: a row counts under the first.
RULES = (
    "drug_id_missing",
    "target_id_missing",
    "score_missing",
    "score_not_a_number",
    "score_not_finite",
    "score_not_positive",
)


def checked_affinity(df: DataFrame, drug_col: str, target_col: str, score_col: str, *keep: str) -> DataFrame:
    """Canonical rows, the score as it was written, and ``Rule``, the first rule a row breaks or null.

    Rows without a rule are those of ``valid_affinity``; nothing is dropped, and it is one projection.
    """
    rows = canonical_affinity(df, drug_col, target_col, score_col, F.col(score_col).cast("string").alias("ScoreText"), *keep)
    score, text = F.col("RawScore"), F.col("ScoreText")
    # NaN is above infinity in Spark's order
    broken = (
        F.col("DrugID").isNull(),
        F.col("TargetID").isNull(),
        text.isNull(),
        score.isNull(),
        (score >= float("inf")) | (score == float("-inf")),
        score <= 0,
    )
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, test in zip(RULES, broken):
        rule = rule.when(test, name)
    return rows.withColumn("Rule", rule)


def accepted_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("Rule").isNull()).drop("Rule", "ScoreText")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("Rule").isNotNull())


def reject_report(checked: DataFrame) -> DataFrame:
    """Per source the raw rows, the valid ones, and those that break each rule first, in one pass."""
    return checked.groupBy("Source").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("Rule").isNull()).alias("valid_rows"),
        *(F.count_if(F.col("Rule") == name).alias(name) for name in RULES),
    )


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("Source", F.lit(name))


def is_valid() -> Column:
    """Both ids are there and the score is positive and finite.

    NaN is above infinity in Spark's order, so one bound keeps both out.
    """
    score = F.col("RawScore")
    return F.col("DrugID").isNotNull() & F.col("TargetID").isNotNull() & (score > 0) & (score < float("inf"))


def valid_affinity(df: DataFrame) -> DataFrame:
    return df.filter(is_valid())


def union_sources(tagged: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources, duplicates kept, matched by column name."""
    return reduce(DataFrame.unionByName, tagged)


def load_sources(available: Sequence[tuple[AffinitySource, DataFrame]]) -> DataFrame:
    """Canonical, tagged and valid rows of the sources that were found."""
    return union_sources(
        [
            tag_source(
                valid_affinity(canonical_affinity(df, source.drug_col, source.target_col, source.score_col)),
                source.name,
            )
            for source, df in available
        ]
    )


def check_sources(available: Sequence[tuple[AffinitySource, DataFrame]]) -> DataFrame:
    """Checked and tagged rows of the sources that were found, valid or not."""
    return union_sources(
        [
            tag_source(checked_affinity(df, source.drug_col, source.target_col, source.score_col), source.name)
            for source, df in available
        ]
    )


def score_affinity(valid: DataFrame, sources: Sequence[AffinitySource] = SOURCES) -> DataFrame:
    """Add the p-scaled (or plain) affinity score and its type."""
    raw, source = F.col("RawScore"), F.col("Source")
    return valid.withColumns(
        {
            "AffinityScore": scores.affinity_score(raw, source, sources),
            "AffinityType": scores.affinity_type(source, sources),
        }
    )


def minmax_by_source(scored: DataFrame, sources: Sequence[AffinitySource] = SOURCES) -> DataFrame:
    """Scale each source to [1, 5] by its own extremes.

    The extremes are a partial aggregate with one row per registered source, so the
    broadcast is bounded by the registry and no source is gathered in one task. As a
    left join on a unique key it vanishes, with its scan, where nobody reads the
    scaled score.
    """
    extremes = (
        scored.filter(F.col("Source").isin(source_names(sources)))
        .groupBy("Source")
        .agg(F.min("AffinityScore").alias("_low"), F.max("AffinityScore").alias("_high"))
    )
    scaled = scores.minmax_scaled(F.col("AffinityScore"), F.col("_low"), F.col("_high"))
    return (
        scored.join(F.broadcast(extremes), "Source", "left")
        .withColumn("NormalizedScore", scaled)
        .select("DrugID", "TargetID", "RawScore", "AffinityScore", "NormalizedScore", "AffinityType", "Source")
    )


def _source_number(sources: Sequence[AffinitySource]) -> Column:
    number = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, source in enumerate(sources):
        number = number.when(F.col("Source") == source.name, i)
    unknown = F.concat(F.lit("source is not registered: "), F.col("Source"))
    return number.otherwise(F.raise_error(unknown).cast("int"))


def integrated_pairs(normalized: DataFrame, sources: Sequence[AffinitySource] = SOURCES) -> DataFrame:
    """One row per pair: mean scores, type of the earliest source, sources and row counts.

    The set of sources is carried as bits of a long (one per ``BITS`` sources) and
    the type as the smallest source number. All aggregation buffers then have a
    fixed width, which keeps the hash aggregate with its map-side combine; names
    are put back once per pair.
    """
    means = {c: F.avg(c) for c in ("NormalizedScore", "AffinityScore")}
    return _paired(normalized, means, F.count(F.lit(1)), sources)


def _paired(rows: DataFrame, means: dict[str, Column], evidence: Column, sources: Sequence[AffinitySource]) -> DataFrame:
    """``rows`` with ``Source`` grouped by pair: the given aggregates, type, sources and their number."""
    blocks = [list(sources)[i : i + BITS] for i in range(0, len(sources), BITS)]
    number = F.col("_number")

    def mask(block: int) -> Column:
        inside = (number >= block * BITS) & (number < (block + 1) * BITS)
        # the function API only takes a literal shift distance
        bit = F.expr(f"shiftleft(1L, pmod(_number, {BITS}))")
        return F.bit_or(F.when(inside, bit).otherwise(F.lit(0).cast("long")))

    masks = {f"_mask{b}": mask(b) for b in range(len(blocks))}
    paired = (
        rows.withColumn("_number", _source_number(sources))
        .groupBy("DrugID", "TargetID")
        .agg(
            *(mean.alias(name) for name, mean in means.items()),
            F.min("_number").alias("_first"),
            *(m.alias(name) for name, m in masks.items()),
            evidence.alias("EvidenceRows"),
        )
    )
    types = F.array(*(F.lit(s.affinity_type) for s in sources))
    seen = sorted(
        (source.name, f"_mask{b}", 1 << i) for b, block in enumerate(blocks) for i, source in enumerate(block)
    )
    names = F.array_compact(
        F.array(*(F.when(F.col(m).bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, m, bit in seen))
    )
    return paired.select(
        "DrugID",
        "TargetID",
        "NormalizedScore",
        "AffinityScore",
        F.get(types, F.col("_first")).alias("AffinityType"),
        names.alias("Sources"),
        reduce(Column.__add__, (F.bit_count(F.col(m)) for m in masks)).cast("long").alias("SourceCount"),
        "EvidenceRows",
    )


def partial_scores(scored: DataFrame) -> DataFrame:
    """One row per pair and source: the sum, number and extremes of its affinity scores.

    All that integration needs of a source's rows. Scaling is affine in each source, so a mean
    of scaled scores follows from the sum and the number, whatever the extremes become later.
    """
    score = F.col("AffinityScore")
    return scored.groupBy("DrugID", "TargetID", "Source").agg(
        F.sum(score).alias("Total"), F.count(score).alias("Rows"), F.min(score).alias("Low"), F.max(score).alias("High")
    )


def merged_partials(partials: DataFrame) -> DataFrame:
    """Rows of several loads added up: one per pair and source."""
    return partials.groupBy("DrugID", "TargetID", "Source").agg(
        F.sum("Total").alias("Total"), F.sum("Rows").alias("Rows"), F.min("Low").alias("Low"), F.max("High").alias("High")
    )


def pairs_of_partials(partials: DataFrame, sources: Sequence[AffinitySource] = SOURCES) -> DataFrame:
    """``integrated_pairs`` of all rows behind ``partials``, which may hold several loads.

    Extremes come from the partial rows, one broadcast row per registered source. Means agree
    with those of the rows but for rounding in the last digits.
    """
    extremes = (
        partials.filter(F.col("Source").isin(source_names(sources)))
        .groupBy("Source")
        .agg(F.min("Low").alias("_low"), F.max("High").alias("_high"))
    )
    # a sum of scaled scores: the scaled mean, times their number
    scaled = scores.minmax_scaled(F.col("Total") / F.col("Rows"), F.col("_low"), F.col("_high")) * F.col("Rows")
    rows = partials.join(F.broadcast(extremes), "Source", "left").withColumn("_scaled", scaled)
    means = {name: F.sum(total) / F.sum("Rows") for name, total in (("NormalizedScore", "_scaled"), ("AffinityScore", "Total"))}
    return _paired(rows, means, F.sum("Rows"), sources)


def dedup_report(pairs: DataFrame) -> DataFrame:
    """Rows before and pairs after integration, in one pass over the pairs."""
    return pairs.agg(
        F.coalesce(F.sum("EvidenceRows"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("pairs_after")
    )


def training_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("DrugID", "TargetID", "NormalizedScore").dropna()


def strong_binders(
    normalized: DataFrame, cut: float = scores.STRONG_CUT, sources: Sequence[AffinitySource] = SOURCES
) -> DataFrame:
    """Concentration measurements at or above a p-scale cut."""
    return normalized.filter(
        F.col("Source").isin(concentration_names(sources)) & (F.col("AffinityScore") >= cut)
    )
