"""Spark session settings the operators rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Results depend on the first (timestamps are UTC wall-clock readings). The others let
# adaptive execution split a hot join key even when that costs one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

BATCH_BYTES = "4m"

_written: list[tuple[object, object, str]] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "cohortline", cores: str | None = None, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own.

    It sets ``spark.checkpoint.dir`` itself, to a folder that goes when the process ends.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.TemporaryDirectory(prefix="cohortline-")
    atexit.register(scratch.cleanup)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", f"file://{scratch.name}/shared")
        .config("spark.sql.warehouse.dir", f"file://{scratch.name}/warehouse")
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset it is a folder in the session's warehouse, which every machine of
    a cluster reaches as well. A machine's temporary folder is never used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return warehouse.rstrip("/") + "/_intermediate"


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder for one intermediate table; it is deleted when the process ends, the session stopped or not."""
    top = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    context = spark.sparkContext
    _written.append((context._jvm, context._jsc.hadoopConfiguration(), top))
    return f"{top}/{name}"


def _delete(jvm, configuration, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(configuration).delete(path, True)


@atexit.register
def _delete_written() -> None:
    for jvm, configuration, folder in _written:
        try:
            _delete(jvm, configuration, folder)
        except Exception as error:  # the JVM has gone or the store refuses: the shared folder's own clean-up takes it
            logging.getLogger(__name__).warning("%s was not deleted: %s", folder, error)
    _written.clear()


@contextmanager
def bucketed(df: DataFrame, column: str, name: str) -> Iterator[DataFrame]:
    """The table, written once in buckets of ``column``, which joins on it read without a shuffle.

    There are as many buckets as shuffle partitions. Inside the block a table bucketed by one of several join keys counts as
    dealt by all. Table and files go when the block ends, so what comes of them must be written before.
    """
    spark, label, key = df.sparkSession, f"{name}_{uuid.uuid4().hex}", "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    folder = new_folder(spark, name)
    writer = df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
    try:
        writer.option("path", folder).saveAsTable(label)
        spark.conf.set(key, "false")
        yield spark.table(label)
    finally:
        spark.conf.set(key, before)
        spark.sql(f"DROP TABLE IF EXISTS {label}")
        _delete(*next(w for w in _written if folder.startswith(w[2])))


@contextmanager
def _set(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside the block, a query's shuffle files are deleted as soon as it has ended.

    Spark otherwise keeps them until the driver collects garbage. It suits chains of written tables, whose shuffles nobody
    reads again; a lost executor during a query is made good as ever.
    """
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries run inside the block send rows to Python in Arrow batches of about 4 MB, not of 10 000 rows however long.

    A batch of texts is held several times over in a task, outside the JVM's heap and in the Python worker. It suits work
    that takes each row by itself; every row is sent as ever.
    """
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        yield


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Compute a table once, write it to the shared folder and read it back.

    Later steps start from the files: lost executors cost no recomputation, scans are
    pruned to the columns used, and the known size lets Spark choose join strategies.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The table as :func:`materialize` gives it, whose files go when the block ends; what comes of it must be written before."""
    table = materialize(df, name)
    written = _written[-1]
    try:
        yield table
    finally:
        _delete(*written)
