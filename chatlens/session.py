"""Session settings and the shared folder for written intermediates."""

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


def local_session(cores="*", shuffle_partitions=8, memory="8g", app="chatlens"):
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark):
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local-mode session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


@functools.cache
def _local_dir():
    path = tempfile.mkdtemp(prefix="chatlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch_path(spark, name):
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/chatlens/{name}-{uuid.uuid4().hex}"


_copies = threading.local()


@contextlib.contextmanager
def passing_copies(spark):
    """Remove at the end the copies that this thread has materialised meanwhile: for work that ends in a write, such
    as a micro-batch, of which nothing is read later."""
    outer, _copies.paths = getattr(_copies, "paths", None), []
    try:
        yield
    finally:
        paths, _copies.paths = _copies.paths, outer
        for path in paths:
            remove(spark, path)


def materialise(df, name):
    """Write df once to the shared folder and read it back.

    The copy is columnar, is computed a single time, and stays readable when
    executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    if getattr(_copies, "paths", None) is not None:
        _copies.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_batches(spark, rows):
    """From now on queries of the session give Python at most so many rows at once; returns the setting before."""
    before = spark.conf.get(_ARROW_ROWS, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(_ARROW_ROWS, str(rows))
    return before


@contextlib.contextmanager
def small_batches(spark, rows):
    """Queries that run meanwhile give Python at most so many rows at once."""
    before = limit_batches(spark, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ARROW_ROWS)
        else:
            spark.conf.set(_ARROW_ROWS, before)


def release(spark):
    """Let Spark remove the shuffle files and broadcasts of finished queries, which it does when the driver's garbage
    goes."""
    spark.sparkContext._jvm.System.gc()


def exists(spark, path):
    """Whether a write to a folder has ended."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def remove(spark, path):
    """Delete a folder below the shared one that no later query reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
