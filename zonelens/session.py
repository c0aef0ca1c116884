"""Session helpers: one place for the settings every job relies on.

The library never builds its own cluster config for production use: the
caller owns the session.  ``get_session`` is for tests, scripts and the
bench; ``checkpoint_dir`` reads the shared folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "zonelens") -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE on and the UI off."""
    master = master or os.environ.get("ZONELENS_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
        # Broadcast only what is provably small: the default 10 MB cap is the
        # size check AQE applies to runtime statistics.
        .config("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        .config("spark.driver.memory", os.environ.get("ZONELENS_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Raises where nothing is configured: a folder on one machine would lose the
    checkpoint with that machine.  Tests call ``setCheckpointDir`` themselves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate or round-trip files, below the shared folder.

    Where no shared folder is set, a session in one process (``local[...]``, as in
    tests) gets one of its own; on a cluster that is an error."""
    try:
        top = checkpoint_dir(spark)
    except RuntimeError:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise
        top = tempfile.mkdtemp(prefix="zonelens-")
        spark.sparkContext.setCheckpointDir(top)
    folder = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    work_folders(spark).append(folder)
    return folder


_made: dict[str, list[str]] = {}


def work_folders(spark: SparkSession) -> list[str]:
    """The work folders that this application has made and not removed, oldest first."""
    return _made.setdefault(spark.sparkContext.applicationId, [])


def remove_work(spark: SparkSession, folders) -> None:
    """Removes work folders that this application has made (others are left alone)."""
    made, context = work_folders(spark), spark.sparkContext
    for folder in [f for f in folders if f in made]:
        made.remove(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what was made within it, but for the folders put into the list
    that it gives: what is returned must read from these alone."""
    before, keep = set(work_folders(spark)), []
    try:
        yield keep
    finally:
        remove_work(spark, [f for f in work_folders(spark) if f not in before and f not in keep])


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Jobs that run within it remove the files of their exchanges at their end; others'
    stay on disk until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: whole
#: texts and pages go through these batches, on both sides of the worker's pipe.
BATCH_ROWS = 2000

_shipped: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python workers, and gives the workers this
    package unless they find it by themselves (as with ``--py-files``, PYTHONPATH or
    the working folder)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    context = spark.sparkContext
    if any(Path(p).resolve() == root for p in known) or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="py-files-")) / "zonelens.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in (root / "zonelens").rglob("*.py"):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
