import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ligatable.operators import integrate
from ligatable.plans import catalog
from ligatable.sources.registry import AffinitySource

ROW = "DrugID STRING, TargetID STRING, RawScore DOUBLE, Source STRING"
NORMALIZED = "DrugID STRING, TargetID STRING, NormalizedScore DOUBLE, AffinityScore DOUBLE, Source STRING"


def test_rows_without_positive_score_or_id_are_dropped(spark, rows):
    raw = spark.createDataFrame(
        [("a", "t", "1.5"), ("a", "t", "0"), ("a", "t", "-2"), ("a", "t", "n/a"), (None, "t", "1"), ("a", None, "1")],
        "d STRING, t STRING, s STRING",
    )
    valid = integrate.valid_affinity(integrate.canonical_affinity(raw, "d", "t", "s"))
    assert rows(valid) == [("a", "t", 1.5)]


def test_pscale_and_type_by_source(spark):
    df = spark.createDataFrame([("a", "t", 30.0, "Kd"), ("a", "t", 30.0, "KIBA")], ROW)
    got = {r.Source: (r.AffinityScore, r.AffinityType) for r in integrate.score_affinity(df).collect()}
    assert got["KIBA"] == (30.0, "KIBA")
    assert got["Kd"][1] == "pKd" and math.isclose(got["Kd"][0], 9 - math.log10(30))


def test_scaling_per_source_and_constant_source(spark):
    df = spark.createDataFrame(
        [("a", "t", 2.0, "Davis"), ("b", "t", 4.0, "Davis"), ("c", "t", 10.0, "Davis"), ("a", "t", 7.0, "KIBA")], ROW
    )
    got = integrate.minmax_by_source(integrate.score_affinity(df)).collect()
    assert sorted((r.Source, r.DrugID, r.NormalizedScore) for r in got) == [
        ("Davis", "a", 1.0), ("Davis", "b", 2.0), ("Davis", "c", 5.0), ("KIBA", "a", 3.0),
    ]


def test_scores_stay_in_range_and_reach_both_ends(spark, sf_dir):
    per_source = catalog.normalized(spark, sf_dir).groupBy("Source").agg(
        F.min("NormalizedScore").alias("low"), F.max("NormalizedScore").alias("high")
    )
    for r in per_source.collect():
        assert math.isclose(r.low, 1.0) and math.isclose(r.high, 5.0)


def test_pairs_merge_sources(spark):
    df = spark.createDataFrame(
        [("a", "t", 2.0, 6.0, "EC50"), ("a", "t", 4.0, 8.0, "KIBA"), ("a", "t", 3.0, 1.0, "EC50"), ("b", "t", 1.0, 2.0, "Ki")],
        NORMALIZED,
    )
    got = {r.DrugID: r for r in integrate.integrated_pairs(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.NormalizedScore, a.AffinityScore) == (3.0, 5.0)
    assert (a.AffinityType, a.Sources, a.SourceCount, a.EvidenceRows) == ("KIBA", ["EC50", "KIBA"], 2, 3)
    assert (b.AffinityType, b.Sources, b.SourceCount, b.EvidenceRows) == ("pKi", ["Ki"], 1, 1)


def test_pairs_with_more_sources_than_bits_in_a_long(spark):
    many = [AffinitySource(f"s{i:03d}", "", "csv", "d", "t", "s", i % 2 == 0) for i in range(150)]
    used = [149, 3, 62, 61, 124, 3]
    df = spark.createDataFrame([("a", "t", 1.0, 1.0, many[i].name) for i in used], NORMALIZED)
    r = integrate.integrated_pairs(df, many).collect()[0]
    assert r.Sources == ["s003", "s061", "s062", "s124", "s149"]
    assert (r.SourceCount, r.EvidenceRows, r.AffinityType) == (5, 6, "s003")


def test_unregistered_source_is_an_error(spark):
    df = spark.createDataFrame([("a", "t", 1.0, 1.0, "other")], NORMALIZED)
    with pytest.raises(PySparkException, match="not registered"):
        integrate.integrated_pairs(df).collect()


def test_evidence_rows_sum_to_the_union(spark, sf_dir):
    report = integrate.dedup_report(catalog.pairs(spark, sf_dir)).collect()[0]
    assert report.rows_before == catalog.valid(spark, sf_dir).count()
    assert report.pairs_after == catalog.valid(spark, sf_dir).select("DrugID", "TargetID").distinct().count()


def test_pair_aggregate_is_a_hash_aggregate_with_one_shuffle(spark, sf_dir):
    pairs = catalog.pairs(spark, sf_dir)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "SinglePartition" not in plan
    # one exchange for the pairs, one for the six extremes
    assert plan.count("Exchange hashpartitioning") == 2


def test_scaling_costs_nothing_where_it_is_not_read(spark, sf_dir):
    unread = catalog.normalized(spark, sf_dir).select("DrugID", "AffinityScore")
    plan = unread._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_strong_binders_only_looks_at_concentrations(spark, rows):
    df = spark.createDataFrame([("a", "t", 1.0, 6.52, "Kd"), ("b", "t", 1.0, 6.5, "Kd"), ("c", "t", 1.0, 9.0, "KIBA")], NORMALIZED)
    assert rows(integrate.strong_binders(df), "DrugID") == [("a",)]
