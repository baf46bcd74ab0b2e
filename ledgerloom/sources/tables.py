"""Zone tables, the invoice store and exports.

A table is a folder of complete versions, `v=<n>`. A write makes a new version and readers move to it
once its `_SUCCESS` marker is there, so a failed write leaves the table as it was. Formats with their
own transactions (`delta`, `iceberg`) are passed through and overwritten in place.
"""

from contextlib import contextmanager

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerloom.schemas import INVOICE
from ledgerloom.session import delete, shuffles_removed, work_path

# Of the Parquet files that the library writes: texts take about half the room that snappy leaves them.
COMPACT = "zstd"
OWN_TRANSACTIONS = {"delta", "iceberg", "hudi"}


def zone_path(base, zone, table):
    return f"{base.rstrip('/')}/{zone}/{table}"


def scan_invoices(spark, path, fmt="parquet", **options):
    """The invoice store with the declared schema. `fmt` may name any installed connector."""
    return spark.read.schema(INVOICE).options(**options).format(fmt).load(path)


def _versions(spark, path):
    """Complete versions of a table, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("v=") and files.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def write_table(df, path, fmt="parquet", partition_by=(), cluster_by=()):
    """Replace a table's content; the schema may change. Returns the number of rows written,
    counted by the write itself.

    `partition_by` makes a folder per value, for columns of few values. `cluster_by` sorts the rows
    into files by ranges of the columns, so that readers skip files and row groups by their
    statistics; end it with a column of many values, such as `("user_id", "id")`, and the rows of one
    large user spread over many files.
    """
    spark = df.sparkSession
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    counter = Observation()
    counted = df.observe(counter, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.format(fmt).partitionBy(*partition_by).mode("overwrite")
    if fmt == "parquet":
        writer = writer.option("compression", COMPACT)
    with shuffles_removed(spark):
        if fmt in OWN_TRANSACTIONS:
            writer.option("overwriteSchema", "true").save(path)
        else:
            versions = _versions(spark, path)
            version = versions[-1] + 1 if versions else 1
            # A version without its marker is left from a failed write and may be replaced.
            writer.save(f"{path}/v={version}")
    return counter.get["rows"]


def read_table(spark, path, fmt="parquet", schema=None):
    """The latest complete version of a table."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in OWN_TRANSACTIONS:
        return reader.load(path)
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no complete version of table {path}")
    return reader.load(f"{path}/v={versions[-1]}")


def drop_old_versions(spark, path, keep=2):
    """Delete all but the last versions of a table. Call when no reader is on an old one."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark._jsc.hadoopConfiguration()
    )
    for version in _versions(spark, path)[:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={version}"), True)


def materialize(df, name):
    """Write a result to the shared folder and read it back: a cut of the lineage that survives
    the loss of executors and keeps columns prunable."""
    return _written(df, work_path(df.sparkSession, name))


def _written(df, path):
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", COMPACT).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark):
    """Gives a function like `materialize`, fit for `settle`, whose tables are removed at the end: for
    steps that have stored their result by then."""
    paths = []

    def keep(df, name):
        paths.append(work_path(spark, name))
        return _written(df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            delete(spark, path)


def settled(df, settle, name):
    """The side of a join whose real size Spark should know when it plans the join.

    `settle` is an option of the operators: false leaves their plan in one piece, true writes this
    part to the shared folder first, a function of the part and its name writes it elsewhere.
    """
    if callable(settle):
        return settle(df, name)
    return materialize(df, name) if settle else df


INDEX_BUCKETS = 64


def write_index(documents, path, buckets=INDEX_BUCKETS):
    """Put search documents into the index folder; an invoice written again replaces its documents.

    The index lies in folders by a hash of the invoice's id. Only the folders that the documents
    belong to are read and replaced, so a small batch leaves most of the index alone.
    """
    spark = documents.sparkSession
    bucket = F.pmod(F.xxhash64("invoice_id"), F.lit(buckets)).cast("int")
    new = materialize(documents.withColumn("bucket", bucket), "index-new")
    touched = [row["bucket"] for row in new.select("bucket").distinct().collect()]  # `buckets` at most
    rows = new
    if touched and _exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
        rows = new.unionByName(old.join(new.select("invoice_id").distinct(), "invoice_id", "left_anti"))
        # Staged, as the folders read are the ones replaced.
        rows = materialize(rows, "index-merged")
    writer = rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_index(spark, path):
    return spark.read.parquet(path).drop("bucket")


def _exists(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def export_data(df, path, fmt="csv"):
    """Rows as CSV (with header, quotes doubled) or JSON lines files. Nested columns become JSON
    text in CSV."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
        return
    if fmt != "csv":
        raise ValueError(f"format must be 'csv' or 'json', not {fmt!r}")
    nested = {"array", "struct", "map"}
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(flat).write.mode("overwrite").options(header=True, escape='"').csv(path)
