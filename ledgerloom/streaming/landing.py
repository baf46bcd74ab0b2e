"""Incremental landing: new invoice files are appended with their audit columns."""

from ledgerloom.operators.medallion import with_audit_columns
from ledgerloom.schemas import INVOICE
from ledgerloom.streaming import with_trigger


def start_landing(spark, source_path, landing_path, checkpoint, fmt="parquet", every=None):
    """Append invoice files not seen before to landing."""
    new = spark.readStream.schema(INVOICE).format(fmt).load(source_path)
    writer = (
        with_audit_columns(new)
        .writeStream.format("parquet")
        .option("path", landing_path)
        .option("checkpointLocation", checkpoint)
    )
    return with_trigger(writer, every).start()
