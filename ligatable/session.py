"""Session settings and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLES_GO_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Checkpoint folders that were found to be shared; Spark names one for each session.
_SHARED: set[str] = set()


def build_session(app: str = "ligatable", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings are left alone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. A path there may be a mount that all
    machines share, or each machine's own disk: it is taken if Spark checkpoints to it and a
    checkpoint that tasks wrote is found whole. Only a local session, where one machine is
    the whole cluster, may name any folder or fall back to a temporary one.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named and (spark.sparkContext.master.startswith("local") or _file_system(spark, named).getScheme() != "file"):
        return named
    in_use = spark.sparkContext.getCheckpointDir()
    if named and not (in_use and _is_shared(spark, in_use)):
        raise RuntimeError(f"{CHECKPOINT_CONF} is {named}, which is another folder on every executor")
    if in_use:
        return os.path.dirname(in_use)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="ligatable-")


def _is_shared(spark: SparkSession, in_use: str) -> bool:
    """Whether the driver finds what tasks write to the checkpoint folder; tried once a session.

    A reliable checkpoint fails if the driver does not see as many parts as there were tasks.
    """
    if in_use not in _SHARED:
        tasks = spark.sparkContext.defaultParallelism
        try:
            spark.range(0, tasks, 1, tasks).checkpoint(eager=True)
        except (PySparkException, Py4JError) as err:
            log.warning("no checkpoint in %s: %s", in_use, err)
            return False
        _SHARED.add(in_use)
    return True


def share_package(spark: SparkSession) -> None:
    """Put this package on the path of Python workers that are yet to start.

    It serves local sessions; a cluster gets the package installed or by ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def _file_system(spark: SparkSession, path: str) -> JavaObject:
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``staging_path`` named, with what was written there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    if not folder.getName().startswith("staged-"):
        raise ValueError(f"{path} is no staged table")
    _file_system(spark, path).delete(folder, True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written on the way to a result."""
    return f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    name_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def name_checkpoints(spark: SparkSession) -> None:
    """Let Spark's checkpoints go to the shared folder, if the session names no other."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each action go when it ends, not when the driver collects its garbage.

    For chains of steps that are written once each and go on from the written copy. A table that
    an action runs again would have its shuffles made again.
    """
    before = spark.conf.get(SHUFFLES_GO_CONF)
    spark.conf.set(SHUFFLES_GO_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO_CONF, before)
