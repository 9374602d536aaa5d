"""Session settings and lineage cuts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CUTS = threading.local()


def local_session(cpus: str | int = "*", app: str = "dwellspark", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter sets these."""
    cores = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every node reaches: ``spark.checkpoint.dir``, else the warehouse folder.

    On a cluster a warehouse on the driver's own disk is no such folder, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir")
        if named.startswith("file:") and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """The Arrow file system of a shared folder, for reads and writes inside tasks, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data on whatever file system it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def cuts_deleted(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the lineage cuts made inside; for flows that end with a write."""
    outer, _CUTS.paths = getattr(_CUTS, "paths", None), []
    try:
        yield
    finally:
        for path in _CUTS.paths:
            delete_folder(spark, path)
        _CUTS.paths = outer


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Each query inside deletes its shuffle files at its end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read back.

    A lost executor re-reads the files instead of re-running the plan. Used where a value
    must not change on re-execution (row numbers) or where one result feeds several branches;
    each branch then reads only its own columns.
    """
    path = new_folder(df.sparkSession, "cut")
    if getattr(_CUTS, "paths", None) is not None:
        _CUTS.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
