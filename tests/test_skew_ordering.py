import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ligatable.operators import model, skew
from ligatable.operators.ordering import quartiles, running_totals
from ligatable.operators.skew import key_salts, one_per, salted_join

RANDOM = random.Random(7)


def skewed(spark, n=600):
    """A third of the rows under one key, some null keys, the rest spread."""
    keys = ["hot"] * (n // 3) + [None] * (n // 10) + [f"k{RANDOM.randrange(40)}" for _ in range(n)]
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key STRING, v INT")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [7, 50, 10**6])
def test_salted_join_equals_plain_join(spark, rows, how, most):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", "h"), ("k1", "a"), ("k1", "b"), ("k2", "c"), ("x", "d")], "key STRING, w STRING")
    if how in ("left_semi", "left_anti"):
        right = right.select("key").distinct()
    assert rows(salted_join(left, right, "key", how, rows_per_task=most)) == rows(left.join(right, "key", how))


def test_salted_join_spreads_the_hot_key(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", "h")], "key STRING, w STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, "key", rows_per_task=50)
        parts = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1


def test_every_hot_key_gets_the_salts_it_needs(spark):
    counts = spark.range(3000).selectExpr("id AS key", "id * 10 AS rows")
    salts = dict(key_salts(counts, "key", 100).collect())
    assert salts == {k: -(-k * 10 // 100) for k in range(11, 3000)}


def test_two_thousand_hot_keys_are_spread(spark, rows):
    left = spark.range(20_000).selectExpr("id % 2000 AS key", "id AS v")
    right = spark.range(2000).selectExpr("id AS key", "id * 2 AS w")
    joined = salted_join(left, right, "key", rows_per_task=3)
    assert rows(joined) == rows(left.join(right, "key"))


def test_one_row_per_key(spark, rows):
    table = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q")], "k STRING, n INT, t STRING")
    assert rows(one_per(table, "k")) == [("a", 1, "y"), ("b", None, "q")]


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        salted_join(spark.range(1), spark.range(1), "id", "full")


def test_running_totals_match_a_loop(spark):
    data = [(g, RANDOM.random(), RANDOM.randrange(9)) for g in ["a"] * 300 + ["b"] * 40 + ["c"]]
    df = spark.createDataFrame(data, "g STRING, o DOUBLE, n INT")
    got = {(r.g, r.o): r.cum_n for r in running_totals(df, [F.col("o")], ["n"], ["g"]).collect()}
    expected, totals = {}, {}
    for g, o, n in sorted(data):
        totals[g] = totals.get(g, 0) + n
        expected[(g, o)] = totals[g]
    assert got == expected


def test_running_totals_use_many_tasks(spark):
    df = spark.range(10_000).withColumn("one", F.lit(1))
    totals = running_totals(df, [F.col("id").desc()], ["one"])
    assert totals.filter("cum_one != 10000 - id").count() == 0
    assert "SinglePartition" not in totals.drop("cum_one")._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(0, 20).map(float), min_size=1, max_size=60))
def test_quartiles_match_numpy(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g STRING, v DOUBLE")
    r = quartiles(df, "g", "v").collect()[0]
    assert np.allclose([r.q1, r.q3], np.quantile(values, [0.25, 0.75]))


def test_quartiles_of_uneven_groups(spark):
    """Far outliers put nearly all rows into one step."""
    data = {"a": [RANDOM.gauss(0, 1) for _ in range(2000)] + [1e9], "b": [RANDOM.random() for _ in range(777)], "c": [2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g STRING, v DOUBLE")
    for r in quartiles(df, "g", "v").collect():
        assert np.allclose([r.q1, r.q3], np.quantile(data[r.g], [0.25, 0.75]))


def test_quartiles_whose_sketch_misses(spark, monkeypatch):
    """Bounds that do not hold a quartile show in the counts, and its group is put in order whole."""
    rows = [(g, float((i * 37) % 1000) ** (g + 1)) for g in range(3) for i in range(1000)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    want = {g: np.percentile([v for h, v in rows if h == g], [25, 75]) for g in range(3)}
    real = F.percentile_approx
    wrong = [
        lambda v, p, a: F.when(F.max("g") == 1, F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0)))).otherwise(real(v, p, a)),
        lambda v, p, a: F.array(*(F.max(v) + i for i in range(4))),
        real,
    ]
    for sketch in wrong:
        monkeypatch.setattr(F, "percentile_approx", sketch)
        got = {r.g: (r.q1, r.q3) for r in quartiles(df, "g", "v").collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_quartiles_read_twice(spark):
    df = spark.range(100_000).selectExpr("id % 4 g", "cast(hash(id) as double) v")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = df.mapInArrow(count, df.schema)
    assert quartiles(watched, "g", "v").count() == 4
    assert seen.value == 2 * 100_000


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_salted_join_moves_each_side_once(spark):
    """Counts of unknown size: their table of salts is broadcast, so both sides shuffle for one join only."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = skew.cut_lineage(spark.range(1000).selectExpr("id % 7 AS k", "id AS v"))
        right = skew.cut_lineage(spark.range(7).selectExpr("id AS k", "id * 10 AS w"))
        counts = skew.cut_lineage(left.groupBy("k").count().withColumnRenamed("count", "rows"))
        joined = skew.salted_join(left, right, "k", counts=counts, rows_per_task=100)
        assert shuffles(joined) == 2
        assert joined.filter("w = k * 10").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_residual_sums_are_not_shuffled(spark):
    """Ratings move to the given factors, then to the solved ones, where they are summed."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        factors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id int, features array<float>")
        ratings = [(float(d), float(t), 1.0 + d * t) for d in range(4) for t in range(4)]
        training = spark.createDataFrame(ratings, "drug_idx double, target_idx double, NormalizedScore double")
        params = model.AlsParams(rank=2, reg=0.0)
        solved = model._residuals(factors, "drug_idx", factors, "target_idx", training, params)
        assert shuffles(solved) == 4
        assert [(r.residual, r.rows) for r in solved.collect()] == [(0.0, 4)] * 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
