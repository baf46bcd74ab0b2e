"""Uploaded files: their content and their properties."""

from pyspark.sql import functions as F

from ledgerloom.functions.intake import (
    content_type_of,
    extension,
    is_accepted_upload,
    upload_path,
)


def read_files(spark, path, glob="*"):
    """Uploaded files as bytes, below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )


def file_properties(spark, path, glob="*"):
    """Name, size, content type and a tag that changes with the file; contents are not read."""
    return read_files(spark, path, glob).select(
        F.col("path").alias("name"),
        F.col("length").alias("size"),
        content_type_of("path").alias("content_type"),
        F.md5(
            F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))
        ).alias("etag"),
    )


def check_uploads(files, user_id="user_id", upload_id="upload_id"):
    """Mark uploads as accepted and give accepted ones their path.

    `files` holds `filename`, `content_type` and `size_bytes` besides the two ids.
    """
    accepted = is_accepted_upload("content_type", "size_bytes")
    return files.withColumn("accepted", accepted).withColumn(
        "blob_path", F.when(accepted, upload_path(user_id, upload_id, "filename"))
    )


def filter_attachments(files, allowed_senders=(), blocked_senders=(), allowed_types=(), max_mb=25):
    """Mailbox rules over `sender`, `filename` and `size_bytes`.

    An empty list allows all. The lists come from a configuration file and stay literals.
    """
    rows = files.filter(F.col("size_bytes") <= max_mb * 1024 * 1024)
    sender = F.lower("sender")
    if allowed_senders:
        rows = rows.filter(sender.isin([s.lower() for s in allowed_senders]))
    if blocked_senders:
        rows = rows.filter(~sender.isin([s.lower() for s in blocked_senders]))
    if allowed_types:
        kinds = [t.lower().lstrip(".") for t in allowed_types]
        rows = rows.filter(extension("filename").isin(kinds))
    return rows
