"""Session construction and the few session-level settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vigil") -> SparkSession:
    """Local or cluster session with UTC time, AQE and skew-join handling on.

    On a cluster ``master`` stays None and the submitter decides; tests pass
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one machine (``local[...]``) may do without: a scratch
    folder is made for it. On a cluster a folder of the driver would be out of the executors' sight, so there it is an error.
    """
    sc = spark.sparkContext
    _show_package(sc)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith(("local[", "local,")) and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("VIGIL_SCRATCH", "/tmp"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # this session's own
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _show_package(sc) -> None:
    """On one machine: this package on the Python workers' path, whatever the current folder (a cluster gets it with --py-files)."""
    root = str(Path(__file__).resolve().parents[1])
    known = sc.environment.get("PYTHONPATH", "") if sc.master.startswith("local") else root
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def materialize(df, name: str = "t"):
    """Cut lineage by writing ``df`` as a parquet table in the shared checkpoint folder and reading it back.

    One computation of the plan (a reliable ``checkpoint()`` computes it twice
    unless cached), and a lost executor only needs the written files. The shuffle files of the write go with its end, not when
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """What runs inside has ``value`` for the session's setting ``key``, which then holds its own again."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends at most ``rows`` rows at a time to Python; the session's own setting holds again afterwards.

    A batch of whole texts lies in memory several times (Arrow's buffers of the JVM, which double as they grow, and the worker's), for each core.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with setting(spark, key, str(min(before, rows) if before > 0 else rows)):
        yield


def run_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared checkpoint folder; all its tables and files lie in it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigil-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for files of one run."""
    return f"{run_folder(spark)}/files/{name}-{uuid.uuid4().hex[:12]}"


def drop_tables(spark: SparkSession) -> None:
    """Delete all that this application has written in the shared folder; for the end of a run, when no result needs it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_if_exists(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` returns, or None if its path does not exist; any other failure is raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
