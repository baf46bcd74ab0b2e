"""Intermediate tables of one operator call, in the shared folder. `session.clear_work` removes what
results still depend on."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import work_path


BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def small_batches(spark: SparkSession):
    """Let Spark hand texts to Python in batches of `BATCH_BYTES`, where the session allows larger
    ones. A batch is held several times, on both sides, in every task."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def release_unused():
    """Give back what Arrow keeps of freed batches. A Python worker outlives its tasks, and what it keeps
    counts as the executor's memory in every later step."""
    pa.default_memory_pool().release_unused()


class Scratch:
    """Writes DataFrames below one new folder and reads them back.

    A stored table cuts the lineage: executors that are lost later cost no recomputation of what came
    before it, and every later reader sees the same rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = work_path(spark, name)
        self._made = 0

    def path(self, name):
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._scratch_path = path
        return stored

    def drop(self, *tables: DataFrame):
        """Remove stored tables that nothing reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
