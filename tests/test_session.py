import os
from urllib.parse import urlparse

import pytest
from compare import differences, open_tables
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from ligatable import session
from ligatable.plans import catalog, oracle
from ligatable.sources import tables


def test_staged_tables_are_dropped(spark):
    path = session.staging_path(spark, "t")
    tables.save_table(spark.range(3), path)
    assert tables.load_table(spark, path).count() == 3
    session.drop_staged(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_table(spark, path)
    with pytest.raises(ValueError, match="no staged table"):
        session.drop_staged(spark, session.shared_dir(spark))


class _Cluster:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("folder", ["/tmp/x", "file:///tmp/x"])
def test_folder_of_one_machine_is_refused_on_a_cluster(spark, monkeypatch, folder):
    named = type("S", (), {"sparkContext": _Cluster(), "_jvm": spark._jvm, "_jsc": spark._jsc})()
    named.conf = type("C", (), {"get": staticmethod(lambda key, default=None: folder)})()
    with pytest.raises(RuntimeError, match="every executor"):
        session.shared_dir(named)


def test_cluster_without_a_folder_is_refused():
    bare = type("S", (), {"sparkContext": _Cluster()})()
    bare.conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()
    with pytest.raises(RuntimeError, match="set spark.checkpoint.dir"):
        session.shared_dir(bare)


@pytest.mark.parametrize("name", ["load_table", "available_sources"])
def test_shared_mount_is_taken_on_a_cluster(spark, sf_dir, monkeypatch, name):
    """The folder is a path, but Spark checkpoints there and the driver sees what tasks wrote."""
    in_use = spark.sparkContext.getCheckpointDir()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set())
    assert urlparse(session.shared_dir(spark)).path == os.path.dirname(urlparse(in_use).path)
    assert getattr(catalog, name)(spark, sf_dir).count() > 0


@pytest.mark.parametrize(
    "name",
    [
        "bucketed_store",
        "export_csv",
        "incremental_pairs",
        "prediction_for_target",
        "predictions_of_drug",
        "read_affinity",
        "read_ppi",
        "save_table",
        "source_choices",
        "source_quality",
        "source_registry",
    ],
)
def test_staged_queries_give_their_rows_on_a_cluster(spark, sf_dir, monkeypatch, name):
    """Each writes a table on its way, which a cluster must not refuse where the folder is shared."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set())
    # a session of the tests that ran nothing else yet
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(spark.conf.get(session.CHECKPOINT_CONF))
    found = getattr(catalog, name)(spark, sf_dir)
    assert differences(found, open_tables(sf_dir), oracle.all_sql()[name]) == []


def test_folder_that_keeps_no_checkpoint_is_refused_on_a_cluster(spark, monkeypatch):
    def lost(df, eager=True):
        raise PySparkException("a different number of partitions")

    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(session.shared_dir(spark))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set())
    monkeypatch.setattr(DataFrame, "checkpoint", lost)
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lost)
    with pytest.raises(RuntimeError, match="every executor"):
        session.shared_dir(spark)
