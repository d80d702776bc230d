"""Session defaults for local runs, and the shared folder for checkpoints."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "reviewlens", memory: str = "12g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own from spark-submit."""
    partitions = 2 * int(cpus) if str(cpus).isdigit() else 16
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = folder or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="reviewlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def durable(df):
    """``df`` written to the checkpoint folder, so later stages never recompute it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_WRITTEN: dict[str, list[str]] = {}
"""Paths of the tables of each application."""


def written_table(df, *partition_by: str) -> str:
    """``df`` as a new Parquet table in the checkpoint folder; returns its path.

    :func:`release` removes the tables once what reads them is done.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return path


def stored(df):
    """``df`` read back from a written table, so later reads prune and push down."""
    return df.sparkSession.read.schema(df.schema).parquet(written_table(df))


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, whichever it is, and the path as it takes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove one table of :func:`written_table`, once nothing reads it any more."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)
    remove(spark, path)


def tables_there(spark: SparkSession) -> list[str]:
    """Paths of the tables written and not removed."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are removed at the end, but for those whose paths are put in the list."""
    before, kept = set(tables_there(spark)), []
    try:
        yield kept
    finally:
        for path in tables_there(spark):
            if path not in before and path not in kept:
                drop_table(spark, path)


def free_exchanges(spark: SparkSession) -> None:
    """Let Spark remove the files of exchanges that nothing can read again.

    It does so once the driver's JVM has collected what led to them, which a driver that
    allocates little puts off for half an hour while the files of many passes pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Remove the tables this application wrote with :func:`written_table`; how many they were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def _checkpoints(spark: SparkSession) -> set[str]:
    """The folders of checkpoints that are there."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        return set()
    files, place = file_system(spark, folder)
    return {str(status.getPath()) for status in files.listStatus(place)} if files.exists(place) else set()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables and checkpoints written inside are removed at the end.

    Write or collect what reads them before, and let nothing else of the application
    checkpoint meanwhile: its checkpoints would go as well.
    """
    app = spark.sparkContext.applicationId
    shared_folder(spark)
    outer, before = _WRITTEN.pop(app, []), _checkpoints(spark)
    try:
        yield
    finally:
        release(spark)
        _WRITTEN[app] = outer
        for path in _checkpoints(spark) - before:
            remove(spark, path)
