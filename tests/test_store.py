"""Bucketed tables, and integration from stored sums."""

import re

import pytest
from pyspark.sql import functions as F

from ligatable.operators import integrate, recommend
from ligatable.plans import catalog, jobs
from ligatable.sources import fixtures, tables
from ligatable.sources.files import SEPARATORS

BY_TARGET = tables.Buckets(("TargetID",), 6)


@pytest.fixture()
def large(spark):
    """Joins as for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_exchange(large, sf_dir, tmp_path, rows):
    pairs, nested = catalog.pairs(large, sf_dir), catalog.nested(large, sf_dir)
    stored = tables.save_bucketed(pairs, f"{tmp_path}/pairs", BY_TARGET)
    predicted = tables.save_bucketed(nested, f"{tmp_path}/predicted", BY_TARGET)
    joined = recommend.measured_evidence(predicted, stored)
    assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    assert rows(joined) == rows(recommend.measured_evidence(nested, pairs)) and joined.count() > 0
    per_target = stored.groupBy("TargetID").agg(F.count("*").alias("n"))
    assert "Exchange" not in plan_of(per_target)
    # a side that is not stored is the only one that moves
    targets = catalog.targets(large, sf_dir)
    mixed = plan_of(stored.join(targets, "TargetID", "left_semi"))
    assert "Exchange" not in mixed[: mixed.index("Scan parquet")]
    # one file a bucket, and a lookup reads the one of its target
    large.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    lookup = stored.filter("TargetID = 'P00007'")
    assert 1 < len(stored.inputFiles()) <= 6 and lookup.count() == pairs.filter("TargetID = 'P00007'").count()
    plan = lookup._jdf.queryExecution().executedPlan()
    large.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount -> 1 out of 6" in plan.collectLeaves().head().metadata().toString()


def test_bucketed_table_is_found_again(spark, sf_dir, tmp_path, rows):
    path = f"{tmp_path}/pairs"
    pairs = catalog.pairs(spark, sf_dir)
    stored = tables.save_bucketed(pairs, path, BY_TARGET)
    assert rows(stored) == rows(pairs) and stored.columns == pairs.columns
    tables.forget_bucketed(spark, path)
    again = tables.load_bucketed(spark, path)
    assert rows(again) == rows(pairs) and again.columns == pairs.columns
    assert "Exchange" not in plan_of(again.groupBy("TargetID").count())
    fewer = tables.save_bucketed(pairs.filter("SourceCount > 1"), path, tables.Buckets(("TargetID", "DrugID"), 3))
    assert rows(fewer) == rows(pairs.filter("SourceCount > 1"))
    empty = tables.save_bucketed(pairs.limit(0), f"{tmp_path}/none", BY_TARGET)
    assert empty.count() == 0 and empty.columns == pairs.columns


def scored(spark, *rows):
    frame = spark.createDataFrame(rows, "DrugID string, TargetID string, Source string, RawScore double")
    return integrate.score_affinity(frame)


def same(one, two):
    """Equal pairs; means agree but for their last digits."""

    def split(df):
        found = sorted(df.collect(), key=lambda r: (r.DrugID, r.TargetID))
        exact = [(r.DrugID, r.TargetID, r.AffinityType, r.Sources, r.SourceCount, r.EvidenceRows) for r in found]
        return exact, [x for r in found for x in (r.NormalizedScore, r.AffinityScore)]

    (exact, means), (exact_two, means_two) = split(one), split(two)
    return exact == exact_two and means == pytest.approx(means_two, abs=1e-9)


def test_sums_give_the_pairs_of_all_rows(spark, sf_dir):
    all_rows = catalog.scored(spark, sf_dir)
    whole = integrate.integrated_pairs(integrate.minmax_by_source(all_rows))
    loads = [integrate.partial_scores(all_rows.filter(F.col("Source") == s)) for s in ("Davis", "KIBA", "IC50")]
    rest = integrate.partial_scores(all_rows.filter(~F.col("Source").isin("Davis", "KIBA", "IC50")))
    old = integrate.merged_partials(integrate.union_sources(loads))
    assert not same(integrate.pairs_of_partials(old), whole)
    assert same(integrate.pairs_of_partials(old.unionByName(rest)), whole)
    assert same(integrate.pairs_of_partials(integrate.merged_partials(old.unionByName(rest))), whole)


def test_extremes_that_move_and_constant_sources(spark):
    old = [("a", "T", "Davis", 1.0), ("b", "T", "Davis", 2.0), ("a", "T", "Davis", 1.5), ("c", "T", "KIBA", 7.0)]
    new = [("z", "U", "Davis", 9.0), ("a", "T", "KIBA", 7.0), ("a", "T", "Ki", 10.0)]
    sums = integrate.partial_scores(scored(spark, *old)).unionByName(integrate.partial_scores(scored(spark, *new)))
    done = integrate.pairs_of_partials(sums)
    assert same(done, integrate.integrated_pairs(integrate.minmax_by_source(scored(spark, *old, *new))))
    one = {r.DrugID: r for r in done.collect()}
    assert one["c"].NormalizedScore == 3.0 and one["z"].NormalizedScore == 5.0
    assert one["a"].Sources == ["Davis", "KIBA", "Ki"] and one["a"].EvidenceRows == 4
    assert integrate.pairs_of_partials(sums.limit(0)).count() == 0


def test_loads_add_up_to_one_integration(spark, sf_dir, tmp_path):
    data, store = str(tmp_path / "all"), str(tmp_path / "store")
    for i, (source, df) in enumerate(fixtures.source_frames(spark, sf_dir)):
        for folder in (data, str(tmp_path / ("late" if i == 2 else "early"))):
            df.write.csv(f"{folder}/{source.file}", header=True, sep=SEPARATORS[source.format])
    assert jobs.stored_loads(spark, store) == []
    first = jobs.add_load(spark, str(tmp_path / "early"), store, "early").collect()
    report = jobs.add_load(spark, str(tmp_path / "late"), store, "late").collect()
    assert jobs.stored_loads(spark, store) == ["early", "late"] and first != report
    with pytest.raises(ValueError, match="stored already"):
        jobs.add_load(spark, str(tmp_path / "late"), store, "late")
    added = jobs.stored(spark, store, jobs.INTEGRATED)
    whole = str(tmp_path / "whole")
    assert jobs.integrate_sources(spark, data, whole).collect() == report
    assert same(added, jobs.stored(spark, whole, jobs.INTEGRATED))


def test_integration_of_sums_moves_each_pair_once(large, sf_dir, tmp_path):
    path = f"{tmp_path}/sums"
    tables.save_table(integrate.partial_scores(catalog.scored(large, sf_dir)), path)
    plan = plan_of(integrate.pairs_of_partials(tables.load_table(large, path)))
    assert len(re.findall(r"Exchange hashpartitioning\(DrugID", plan)) == 1 and "SortAggregate" not in plan
