import threading
import time
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ligatable.operators import evaluate, model, recommend, skew
from ligatable.plans import catalog

from ligatable.session import cut_lineage

PAIR = "DrugID STRING, TargetID STRING, NormalizedScore DOUBLE"


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings of a rank-2 matrix, three quarters of it seen."""
    rng = np.random.default_rng(3)
    u, v = rng.uniform(0.5, 1.5, (40, 2)), rng.uniform(0.5, 1.5, (25, 2))
    data = [(f"d{i}", f"t{j}", float(u[i] @ v[j])) for i in range(40) for j in range(25) if rng.random() < 0.75]
    return spark.createDataFrame(data, PAIR).cache()


@pytest.fixture(scope="module")
def fitted(planted):
    return model.fit_recommender(planted, model.AlsParams(rank=4, reg=0.01))


def test_labels_equal_the_string_indexer(spark, sf_dir):
    pairs = catalog.stored_pairs(spark, sf_dir)
    labels = model.label_index(pairs, "DrugID", "drug_idx").orderBy("drug_idx").collect()
    assert [r.DrugID for r in labels] == StringIndexer(inputCol="DrugID", outputCol="i").fit(pairs).labels
    assert [r.drug_idx for r in labels] == list(range(len(labels)))


def test_unseen_ids_get_the_next_index(spark, rows):
    known = spark.createDataFrame([("a", "t", 1.0), ("a", "u", 1.0), ("b", "t", 1.0)], PAIR)
    drugs, targets = model.label_index(known, "DrugID", "drug_idx"), model.label_index(known, "TargetID", "target_idx")
    new = spark.createDataFrame([("b", "t", 1.0), ("x", "u", 1.0), ("a", "y", 1.0)], PAIR)
    assert rows(model.index_ids(new, drugs, targets), "DrugID", "TargetID", "drug_idx", "target_idx") == [
        ("a", "y", 0.0, 2.0), ("b", "t", 1.0, 0.0), ("x", "u", 2.0, 1.0),
    ]


def test_labels_grow_without_moving(spark, rows):
    load = lambda *ids: spark.createDataFrame([(i,) for i in ids], "DrugID STRING")
    labels = model.label_index(load("b", "b", "a"), "DrugID", "drug_idx")
    more = model.extend_labels(labels, load("z", "a", "c", "z", None, None), "DrugID", "drug_idx")
    assert rows(more) == [("a", 1, 2), ("b", 0, 2), ("c", 3, 1), ("z", 2, 2)]
    assert rows(model.extend_labels(more, load(), "DrugID", "drug_idx")) == rows(more)
    first = model.extend_labels(labels.limit(0), load("y", "x", "y"), "DrugID", "drug_idx")
    assert rows(first) == rows(model.label_index(load("y", "x", "y"), "DrugID", "drug_idx")) == [("x", 1, 1), ("y", 0, 2)]


def test_split_ignores_partitioning_and_is_about_four_fifths(spark, sf_dir, rows):
    pairs = catalog.stored_pairs(spark, sf_dir)
    training, test = model.split_pairs(pairs)
    assert rows(training) == rows(model.split_pairs(pairs.repartition(13))[0])
    assert training.count() + test.count() == pairs.count()
    assert 0.75 < training.count() / pairs.count() < 0.85


def test_cold_start_rows_are_dropped(spark, rows):
    training = spark.createDataFrame([("a", "t", 1.0), ("b", "u", 1.0)], PAIR)
    test = spark.createDataFrame([("a", "u", 1.0), ("c", "t", 1.0), ("a", "v", 1.0)], PAIR)
    assert rows(model.drop_cold_start(test, training)) == [("a", "u", 1.0)]


def test_training_recovers_a_planted_matrix(fitted):
    assert evaluate.rmse(fitted.predictions()).collect()[0].rmse < 0.1


def test_recommendations_are_the_best_products_of_the_factors(fitted):
    users = {r.id: np.array(r.features) for r in fitted.model.userFactors.collect()}
    names = {r.drug_idx: r.DrugID for r in fitted.drug_labels.collect()}
    targets = {r.target_idx: r.TargetID for r in fitted.target_labels.collect()}
    got = {r.TargetID: [(x.DrugID, x.score) for x in r.recommendations] for r in fitted.recommendations(5).collect()}
    for item in fitted.model.itemFactors.collect():
        scores = sorted(((float(u @ np.array(item.features)), names[i]) for i, u in users.items()), reverse=True)[:5]
        assert np.allclose([s for _, s in got[targets[item.id]]], [s for s, _ in scores], atol=1e-5)
        assert len(got[targets[item.id]]) == 5


def test_same_seed_same_recommendations(planted, fitted):
    again = model.fit_recommender(planted, fitted.params)
    first = {r.TargetID: [x.DrugID for x in r.recommendations] for r in fitted.recommendations().collect()}
    assert first == {r.TargetID: [x.DrugID for x in r.recommendations] for r in again.recommendations().collect()}


def test_recommending_for_some_targets(spark, fitted):
    some = fitted.target_labels.filter("target_idx < 3")
    assert model.recommend_for_targets(fitted.model, some, 2).count() == 3


def test_encoding_and_decoding_are_inverse(planted, fitted, rows):
    coded = model.index_ids(planted, fitted.drug_labels, fitted.target_labels)
    flat = coded.select("target_idx", "drug_idx", F.col("NormalizedScore").alias("score"))
    decoded = model.decode_ids(flat, fitted.drug_labels, fitted.target_labels)
    assert rows(decoded, "DrugID", "TargetID", "score") == rows(planted)


def test_model_does_not_depend_on_the_cluster(planted, fitted, monkeypatch):
    """Equal predictions under another default parallelism and partitioning."""
    first = {(r.DrugID, r.TargetID): r.prediction for r in fitted.predictions().collect()}
    context = type(planted.sparkSession.sparkContext)
    monkeypatch.setattr(context, "defaultParallelism", property(lambda self: 3))
    again = model.fit_recommender(planted.repartition(3), fitted.params).predictions().collect()
    assert {(r.DrugID, r.TargetID): r.prediction for r in again} == pytest.approx(first, abs=1e-4)


def test_predictions_are_those_of_the_trained_model(fitted):
    theirs = {(r.DrugID, r.TargetID): r.prediction for r in fitted.model.transform(fitted.test).collect()}
    ours = {(r.DrugID, r.TargetID): r.prediction for r in fitted.predictions().collect()}
    assert ours == pytest.approx(theirs, abs=1e-5)


def test_products_of_all_factors_are_computed_once(spark, fitted, monkeypatch):
    """One job tree holds the cross join of the factors: the one that writes the flat rows."""
    seen = []
    cut = skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: seen.append(df._jdf.queryExecution().toString()) or cut(df))
    result = fitted.recommendations()
    assert sum("CartesianProduct" in plan or "NestedLoop" in plan for plan in seen) == 1
    assert "CartesianProduct" not in result._jdf.queryExecution().executedPlan().toString()


def test_near_ties_rank_by_full_precision(spark, rows):
    pairs = spark.createDataFrame([("a", "t", 3.0000001), ("b", "t", 3.0000003)], PAIR)
    assert rows(recommend.measured_recommendations(pairs, 1), "DrugID") == [("b",)]


def test_metrics_equal_the_evaluators(fitted):
    scored = evaluate.binarize_label(fitted.predictions().withColumn("NormalizedScore", F.col("NormalizedScore") * 1.5)).cache()
    rmse = RegressionEvaluator(metricName="rmse", labelCol="NormalizedScore", predictionCol="prediction").evaluate(scored)
    pr = BinaryClassificationEvaluator(rawPredictionCol="prediction", labelCol="TrueLabel", metricName="areaUnderPR", numBins=0)
    assert evaluate.rmse(scored).collect()[0].rmse == pytest.approx(rmse)
    assert evaluate.aupr(scored).collect()[0].aupr == pytest.approx(pr.evaluate(scored))


def test_aupr_with_ties_and_without_positives(spark):
    tied = spark.createDataFrame([(1.0, 0.9), (0.0, 0.9), (0.0, 0.5), (1.0, 0.1)], "TrueLabel DOUBLE, prediction DOUBLE")
    pr = BinaryClassificationEvaluator(rawPredictionCol="prediction", labelCol="TrueLabel", metricName="areaUnderPR", numBins=0)
    assert evaluate.aupr(tied).collect()[0].aupr == pytest.approx(pr.evaluate(tied))
    assert evaluate.aupr(tied.filter("TrueLabel = 0")).collect()[0].aupr == 0.0


def test_metrics_record_and_latest(spark, fitted):
    record = evaluate.metrics_record(fitted.predictions(), fitted.params)
    assert [(f.name, f.dataType.typeName()) for f in record.schema.fields] == [
        ("algorithm", "string"), ("rmse", "double"), ("aupr", "double"), ("rank", "long"), ("regParam", "double"),
        ("maxIter", "long"), ("implicitPrefs", "boolean"), ("drugBlocks", "long"), ("targetBlocks", "long"),
        ("timestamp", "timestamp"),
    ]
    history = spark.createDataFrame([("a", 1), ("c", 3), ("b", 2)], "algorithm STRING, timestamp INT")
    assert [r.algorithm for r in evaluate.latest_metrics(history).collect()] == ["c"]
    assert evaluate.latest_metrics(history.limit(0)).count() == 0


def test_target_residuals_show_wrong_factors(fitted):
    """Trained factors solve their equations; shifted ones do not, nor those of another iteration's drugs."""
    before = model.train_als(fitted.training, replace(fitted.params, iterations=fitted.params.iterations - 1))

    def worst(trained, given):
        found = model.target_residuals(trained, given, fitted.training, fitted.params).collect()
        return max(r.residual / r.rows for r in found), len(found)

    n = fitted.training.select("target_idx").distinct().count()
    good, size = worst(fitted.model, before)
    assert good < catalog.RESIDUAL and size == n
    shifted = fitted.model.itemFactors.withColumn("features", F.transform("features", lambda x: x * F.lit(1.05).cast("float")))
    assert worst(SimpleNamespace(itemFactors=shifted), before)[0] > catalog.RESIDUAL


def shuffles(spark):
    """The shuffles that have files on disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = blocks.mkString(" ").split()
    return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}


def left_after(spark, known):
    """New shuffles that stay; files go a little after they are given up."""
    for _ in range(50):
        if not (left := shuffles(spark) - known):
            break
        time.sleep(0.2)
    return left


def test_training_holds_the_shuffles_of_one_iteration(spark, planted):
    """The disk holds what one iteration sends, and nothing of it once the model stands (F1 to F5)."""
    pairs = cut_lineage(planted)
    known, most, done = shuffles(spark), [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            most[0] = max(most[0], len(shuffles(spark) - known))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        trained = model.fit_recommender(pairs, model.AlsParams(rank=4, reg=0.01))
    finally:
        done.set()
        watcher.join()
    # three of the ratings' blocks and two or three of an iteration; before, ten iterations stayed
    assert 0 < most[0] < 14
    assert not left_after(spark, known)
    assert trained.model.userFactors.count() == trained.drug_labels.count() == 40
    assert trained.predictions().count() > 0


def test_pairs_go_once_they_are_encoded(spark, planted):
    """The caller is told when its pairs are no longer read (F5)."""
    calls = []
    pairs = cut_lineage(planted)
    model.fit_recommender(pairs, model.AlsParams(rank=2, iterations=1), encoded=lambda: calls.append(1))
    assert calls == [1]


@pytest.mark.parametrize("ratings", [1 << 25, 200])
def test_residuals_come_in_passes(spark, fitted, monkeypatch, rows, ratings):
    """However few ratings meet their factors at once, the residuals are the same (F2, F5)."""
    whole = rows(model.drug_residuals(fitted.model, fitted.training, fitted.params).withColumn("residual", F.round("residual", 4)))
    passes, one = [], model._residuals
    monkeypatch.setattr(model, "RATINGS_A_PASS", ratings)
    monkeypatch.setattr(model, "_residuals", lambda *a: passes.append(1) or one(*a))
    known = shuffles(spark)
    found = model.drug_residuals(fitted.model, fitted.training, fitted.params)
    assert not left_after(spark, known)
    assert rows(found.withColumn("residual", F.round("residual", 4))) == whole and len(whole) == 40
    assert len(passes) == -(-fitted.training.count() // ratings)


@pytest.mark.parametrize(("name", "evaluators"), [("score_pairs", 0), ("metrics_record", 3), ("train_als_targets", 0)])
def test_queries_hold_no_shuffles_of_earlier_steps(spark, sf_dir, name, evaluators):
    """Only what Spark's own evaluators shuffle stays; scores of both sides are written apart (F2 to F4)."""
    known = shuffles(spark)
    query = catalog.all_queries()[name](spark, sf_dir)
    left = left_after(spark, known) if not evaluators else shuffles(spark) - known
    assert len(left) <= evaluators
    assert "features" not in query._jdf.queryExecution().optimizedPlan().toString()
