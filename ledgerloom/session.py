"""Session settings and the shared folder for intermediate tables."""

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name="ledgerloom", master=None, **conf):
    """A session with the settings the operators rely on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder all executors can reach: `spark.checkpoint.dir`, or what `setCheckpointDir` named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured.rstrip("/")


def _work_folder(spark):
    return f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}"


def work_path(spark, name):
    """A new path below the shared folder, in the application's own sub-folder."""
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark, path):
    """Delete a folder written before, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark):
    """Writes in here remove their shuffle files as soon as they end. Without it the files stay until the
    driver happens to collect garbage, and add up over the steps of a job."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def clear_work(spark):
    """Delete what this application wrote to the shared folder. Results read from it are gone."""
    delete(spark, _work_folder(spark))
