from pyspark.sql import functions as F

from ligatable.operators import recommend
from ligatable.plans import catalog, jobs
from ligatable.sources import fixtures, tables
from ligatable.sources.files import SEPARATORS


def test_both_jobs_end_to_end(spark, sf_dir, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    for source, df in fixtures.source_frames(spark, sf_dir):
        df.write.csv(f"{data}/{source.file}", header=True, sep=SEPARATORS[source.format])
    fixtures.raw_ppi(spark, sf_dir).write.csv(f"{data}/{jobs.PPI_FILE}", header=True, sep=" ")

    report = jobs.integrate_sources(spark, data, store).collect()[0]
    expected = catalog.dedup_report(spark, sf_dir).collect()[0]
    assert tuple(report) == tuple(expected)
    assert jobs.stored(spark, store, jobs.PPI_EDGES).count() == catalog.edges(spark, sf_dir).count()

    for run in (1, 2):
        metrics = jobs.train_and_recommend(spark, store).collect()
        assert len(metrics) == 1 and metrics[0].rmse > 0
        assert jobs.stored(spark, store, jobs.METRICS).count() == run

    predictions = jobs.stored(spark, store, jobs.PREDICTIONS)
    assert predictions.count() == jobs.stored(spark, store, jobs.INTEGRATED).select("TargetID").distinct().count()
    assert predictions.agg(F.max(F.size("recommendations"))).collect()[0][0] <= 5
    ranked = recommend.ranked_recommendations(tables.prediction_for_target(predictions, "P00007")).collect()
    assert [r.Rank for r in ranked] == list(range(1, len(ranked) + 1))
