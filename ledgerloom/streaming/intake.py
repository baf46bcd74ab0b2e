"""File events to queue messages."""

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ledgerloom.functions.intake import (
    CREATED_EVENT,
    blob_name,
    is_supported_file,
    path_source,
    path_upload_id,
    path_user,
    stable_id,
    subject_prefix,
)
from ledgerloom.functions.normalize import parse_float, present
from ledgerloom.schemas import EVENT, MESSAGE
from ledgerloom.streaming import with_trigger


def parse_events(lines):
    """Events from JSON text in `value`: one event, or a list of them, per row."""
    events = F.from_json("value", ArrayType(EVENT))
    return lines.select(F.explode(events).alias("_event")).select("_event.*")


def malformed_events(lines):
    """Lines `parse_events` gets nothing from because they are not JSON, as they came."""
    return lines.filter(F.from_json("value", ArrayType(EVENT)).isNull())


def subscribed(events, container):
    """Events the subscription delivers: files created in the container."""
    return events.filter(
        (F.col("eventType") == CREATED_EVENT)
        & F.col("subject").startswith(subject_prefix(container))
    )


def accept_events(events, container):
    """Queue messages for created files of a supported type.

    The correlation id depends on the file alone, so a second delivery gets it again.
    """
    named = events.filter(F.col("eventType") == CREATED_EVENT).withColumn(
        "blob_path", blob_name("subject", F.col("data.url"))
    )
    kept = named.filter(present("blob_path") & is_supported_file("blob_path"))
    return kept.select(
        "blob_path",
        F.lit(container).alias("container_name"),
        path_user("blob_path").alias("user_id"),
        path_source("blob_path").alias("source"),
        path_upload_id("blob_path").alias("upload_id"),
        stable_id(F.lit("message"), F.lit(container), "blob_path").alias("correlation_id"),
        F.coalesce("data.contentType", F.lit("")).alias("content_type"),
        F.coalesce(
            parse_float(F.col("data.contentLength").cast("string")).try_cast("bigint"), F.lit(0)
        ).alias("file_size_bytes"),
    )


def to_queue(messages):
    """Messages as one JSON text per row, as a queue takes them."""
    return messages.select(F.to_json(F.struct(*MESSAGE.names)).alias("value"))


def from_queue(lines):
    """Messages from JSON text; absent optional fields take their defaults.

    Rows without a path or container cannot be processed and are left to `malformed`.
    """
    defaults = {
        "user_id": "system",
        "source": "upload",
        "upload_id": "",
        "correlation_id": "",
        "content_type": "",
        "file_size_bytes": 0,
    }
    parsed = lines.select(F.from_json("value", MESSAGE).alias("_m")).select("_m.*")
    usable = parsed.filter(F.col("blob_path").isNotNull() & F.col("container_name").isNotNull())
    return usable.select(
        *[
            F.coalesce(name, F.lit(defaults[name])).alias(name) if name in defaults else name
            for name in MESSAGE.names
        ]
    )


def malformed(lines):
    """Queue rows that `from_queue` leaves out, as they came."""
    m = F.from_json("value", MESSAGE)
    return lines.filter(m["blob_path"].isNull() | m["container_name"].isNull())


def start_intake(spark, events_path, queue_path, checkpoint, container, max_files=None, every=None):
    """Turn event files not seen before into messages; a message file is written once."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    events = subscribed(parse_events(reader.load(events_path)), container)
    writer = (
        to_queue(accept_events(events, container))
        .writeStream.format("parquet")
        .option("path", queue_path)
        .option("checkpointLocation", checkpoint)
    )
    return with_trigger(writer, every).start()


def start_malformed(spark, events_path, kept_path, checkpoint, max_files=None, every=None):
    """The second sink of the intake: lines of event files that are no JSON, kept as they came.

    It reads the same files as `start_intake` under a checkpoint of its own, so neither sink can hold
    the other up or lose a line of it.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (
        malformed_events(reader.load(events_path))
        .writeStream.format("parquet")
        .option("path", kept_path)
        .option("checkpointLocation", checkpoint)
    )
    return with_trigger(writer, every).start()
