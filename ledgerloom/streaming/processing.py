"""Queue messages to invoice records.

The invoice store is a folder that only grows: every micro-batch writes its own sub-folder
`run=<query>/batch=<n>`, and writing it again after a failure replaces it. The current table is the
first processed record of each id, so a second delivery changes nothing and a success replaces an
earlier failure.

A batch never reads the records stored before. Beside them it keeps three narrow tables of sorted runs
(`sources/runs.py`), of which it reads the pages that its own messages, invoices and vendors hash to:

* `_ids`: the ids processed so far,
* `_keys`: the keys that stored invoices are filed under for the duplicate check,
* `_vendors`: count and sum per vendor, for the flag of unusually high amounts.

The search documents of a batch's invoices go to `_index`, rows that are no messages to `_malformed`.
"""

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerloom.functions.intake import path_upload_id, stable_id, utc_now_text
from ledgerloom.functions.money import exact_money
from ledgerloom.functions.normalize import iso_date, normalize_currency
from ledgerloom.operators.classification import anomaly_flags, classify_with_rules
from ledgerloom.operators.duplicates import flag_duplicates, key_table
from ledgerloom.operators.extraction import (
    EXTRACTION_MODEL,
    extract_fields,
    parse_classification,
)
from ledgerloom.operators.latest import first_per_key, first_per_repeated_key, row_hash
from ledgerloom.operators.lookup import HASH, KEY, group_values, join_values
from ledgerloom.operators.search import cut_stored_text, search_documents
from ledgerloom.schemas import INVOICE
from ledgerloom.session import delete
from ledgerloom.sources.runs import RunTable
from ledgerloom.sources.tables import COMPACT
from ledgerloom.streaming import with_trigger
from ledgerloom.streaming.intake import from_queue, malformed, to_queue

_ORDER = "struct<_arrival:int,processed_at:string,id:string>"
_FILED_KEY = "struct<vendor_name:string,total_amount:double,invoice_date:string>"
SIDE_TABLES = {
    "_ids": f"{HASH} long, id string",
    "_keys": f"{HASH} long, {KEY} {_FILED_KEY}, _order {_ORDER}",
    "_vendors": f"{HASH} long, vendor_name string, total decimal(34,6), n long",
}

# What a failure record keeps.
FAILURE_COLUMNS = [
    "id", "user_id", "source", "blob_path", "status", "correlation_id", "processed_at",
]


def vendor_totals(invoices):
    """Exact sum and count of the amounts per vendor, as `_vendors` keeps them."""
    amount = exact_money("total_amount")
    return invoices.groupBy("vendor_name").agg(
        F.sum(amount).cast("decimal(34,6)").alias("total"), F.count(amount).alias("n")
    )


def by_rules(extracted, totals=None):
    """Classification by keyword rules, and flags by rule.

    The average that an amount is compared with is over the vendor's invoices in `totals`, those
    processed before, and in this batch. Amounts beyond the exact decimal do not count.
    """
    own = vendor_totals(extracted.filter(~F.col("extraction_failed")))
    every = own if totals is None else own.unionByName(totals)
    averages = group_values(
        every, ["vendor_name"], _average=F.try_divide(F.sum("total"), F.sum("n")).cast("double")
    )
    flags = anomaly_flags(
        F.col("total_amount"), F.col("purchase_order"), iso_date("invoice_date"), F.col("_average")
    )
    return (
        join_values(classify_with_rules(extracted), F.struct("vendor_name"), averages)
        .withColumns(
            {
                "spend_category": F.col("rule_category"),
                "subcategory": F.lit(""),
                "is_likely_duplicate": F.lit(False),
                "anomaly_flags": flags,
                "classification_confidence": F.when(F.col("rule_weight") > 0, 1.0).otherwise(0.0),
                "classification_reasoning": F.lit("keyword rules"),
            }
        )
        .drop("rule_category", "rule_weight", "_average")
    )


def _with_file_rows(files, table, value):
    """Join files, unique by `blob_path`, to the row a table holds for them.

    Rows of other files fall away first, in the scan when the files are few. Should a table hold
    several rows for a file, the one with the smallest hash counts.
    """
    wanted = table.join(files.select("blob_path"), "blob_path", "left_semi")
    first = first_per_key(wanted, ["blob_path"], [F.xxhash64(value), F.length(value)])
    return files.join(first, "blob_path", "left")


def by_replies(replies):
    """Classification by stored model replies: `blob_path` and `reply`. Flags are the model's."""

    def classify(extracted, totals=None):
        return parse_classification(_with_file_rows(extracted, replies, "reply")).drop("is_valid")

    return classify


def extract_messages(messages, results, classify=by_rules, processed_at=None, totals=None):
    """Extracted and classified messages, one row per file; `extraction_failed` marks the rest.

    `results` holds `blob_path` and the JSON analysis `result`. `processed_at` is a fixed ISO time
    for the records instead of the current one. `classify` gets the extracted rows and the totals of
    vendors processed before.
    """
    message_columns = ["id", "user_id", "source", "blob_path", "correlation_id"]
    ids = messages.withColumn("id", stable_id("container_name", "blob_path"))
    once = first_per_key(ids, ["id"], [row_hash(ids)]).select(message_columns)
    extracted = extract_fields(_with_file_rows(once, results, "result"))
    now = utc_now_text() if processed_at is None else F.lit(processed_at)
    return classify(extracted.withColumn("processed_at", now), totals)


def finish_records(classified, stored=None, stored_chars=None, settle=False, filed=None):
    """Invoice records of classified messages, after the duplicate check (arguments as there).

    A message without a usable result gives a failure record. `stored_chars` cuts the stored text;
    by default it is kept whole.
    """
    failed = F.col("extraction_failed")
    record = flag_duplicates(classified, stored, settle, filed).withColumns(
        {
            "status": F.when(failed, "failed").otherwise("processed"),
            "currency": normalize_currency("currency"),
            "extraction_model": F.lit(EXTRACTION_MODEL),
            "classification_model": F.lit(""),
            "tags": F.array().cast("array<string>"),
            "notes": F.lit(""),
        }
    )
    if stored_chars is not None:
        record = cut_stored_text(record, stored_chars)
    return record.select(
        *[
            (F.col(c) if c in FAILURE_COLUMNS else F.when(~failed, F.col(c))).alias(c)
            for c in INVOICE.names
        ]
    )


def _folder(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def read_store(spark, store):
    """All records written so far, with `run` and `batch`."""
    schema = StructType(
        [*INVOICE.fields, StructField("run", StringType()), StructField("batch", LongType())]
    )
    files, folder = _folder(spark, store)
    if not files.exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(store)


def compact_store(spark, store, target):
    """Write the current records of a store, with its narrow tables and its index, as a new store to
    read and extend instead: one folder in place of one per batch."""
    current_invoices(spark, store).write.parquet(f"{target}/run=compacted/batch=0")
    for name in SIDE_TABLES:
        rows = _COMBINE[name](side_table(spark, store, name).rows())
        side_table(spark, target, name).put(rows, "compacted", 0)
    read_documents(spark, store).write.parquet(f"{target}/_index/run=compacted/batch=0")


def current_invoices(spark, store, settle=True):
    """One record per id: processed before failed, then the one processed first. Only records of ids
    that have several are ranked (`settle` as in `first_per_repeated_key`)."""
    rows = read_store(spark, store).drop("run", "batch")
    # Hashed before rows move, so that of those that do only the columns asked for come along.
    rows = rows.withColumn("_row_hash", row_hash(rows))
    order = [F.col("status") != "processed", "processed_at", "_row_hash"]
    if not settle:
        return first_per_key(rows, ["id"], order).drop("_row_hash")
    return first_per_repeated_key(rows, ["id"], order, settle).drop("_row_hash")


def _earliest(keys):
    """Of the invoices under a key the first one is enough to tell later ones that they repeat it."""
    return keys.groupBy(HASH, KEY).agg(F.min("_order").alias("_order"))


def _added_up(totals):
    return totals.groupBy(HASH, "vendor_name").agg(
        F.sum("total").cast("decimal(34,6)").alias("total"), F.sum("n").alias("n")
    )


_COMBINE = {"_ids": lambda ids: ids.distinct(), "_keys": _earliest, "_vendors": _added_up}


def side_table(spark, store, name):
    """A narrow table of the store."""
    return RunTable(spark, f"{store}/{name}", SIDE_TABLES[name], HASH, _COMBINE[name])


def _hashed(rows, column):
    return rows.withColumn(HASH, F.xxhash64(column))


def read_documents(spark, store):
    """The search documents of all invoices processed, one per id."""
    files, folder = _folder(spark, f"{store}/_index")
    empty = search_documents(spark.createDataFrame([], INVOICE))
    if not files.exists(folder):
        return empty
    return spark.read.schema(empty.schema).parquet(f"{store}/_index").select(empty.columns)


def process_into(store, results, classify=by_rules, processed_at=None, stored_chars=None):
    """A `foreachBatch` function that processes queue rows into the store.

    Messages, classified rows, records and duplicates of the batch are staged inside the store. So
    Spark knows how small they are when it plans their joins with the narrow tables and the results,
    and rows that several steps read are computed once. Queue rows that are no messages are kept in
    `_malformed` below the store.

    `results` may be a function that returns the table, to be read anew for every batch.
    """

    def handle(batch, number):
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        target = f"run={run}/batch={number}"
        own = (run, number)  # what an earlier attempt of the batch left

        def write(df, path):
            df.write.mode("overwrite").option("compression", COMPACT).parquet(path)

        def staged(df, name):
            path = f"{store}/_staging/{target}/{name}"
            write(df, path)
            return spark.read.schema(df.schema).parquet(path)

        side = {name: side_table(spark, store, name) for name in SIDE_TABLES}

        write(malformed(batch), f"{store}/_malformed/{target}")
        messages = from_queue(batch).withColumn("id", stable_id("container_name", "blob_path"))
        messages = staged(_hashed(messages, "id"), "messages")
        done = side["_ids"].find(messages, own)
        known = done.select("id").distinct()
        fresh = messages.join(known, "id", "left_anti").drop("id", HASH)
        table = results() if callable(results) else results

        def classified_with_totals(extracted, totals=None):
            extracted = staged(extracted, "extracted")
            wanted = _hashed(extracted.select("vendor_name").distinct(), "vendor_name")
            totals = side["_vendors"].find(wanted, own).drop(HASH)
            return classify(extracted, totals.join(wanted, "vendor_name", "left_semi"))

        extracted = extract_messages(fresh, table, classified_with_totals, processed_at)
        classified = staged(extracted, "classified")

        def filed(asked):
            return side["_keys"].find(asked, own)

        records = finish_records(classified, None, stored_chars, settle=staged, filed=filed)
        write(records, f"{store}/{target}")
        written = spark.read.schema(records.schema).parquet(f"{store}/{target}")
        processed = written.filter("status = 'processed'")
        side["_ids"].put(_hashed(processed.select("id"), "id"), *own)
        side["_keys"].put(key_table(processed), *own)
        side["_vendors"].put(_hashed(vendor_totals(processed), "vendor_name"), *own)
        # An id is processed once, so a batch of its own folder replaces nothing but itself.
        write(search_documents(processed, unique=True), f"{store}/_index/{target}")
        delete(spark, f"{store}/_staging/{target}")

    return handle


def retry_failed(spark, store, results, queue_path, container):
    """Queue messages again for failed files whose analysis result exists by now; returns how many.

    `queue_path` is a queue of its own, processed into the same store under a checkpoint of its own:
    a folder that the intake stream writes shows its readers that stream's files only. Reads the
    store's status columns; run it as a job, after results have arrived. A file queued twice is
    processed once.
    """
    columns = ["id", "user_id", "source", "blob_path", "correlation_id"]
    failed = read_store(spark, store).filter("status = 'failed'").select(columns).distinct()
    done = side_table(spark, store, "_ids").rows().select("id")
    waiting = failed.join(done, "id", "left_anti")
    usable = results.filter(F.col("result").isNotNull()).select("blob_path")
    waiting = first_per_key(waiting.join(usable, "blob_path", "left_semi"), ["id"], ["correlation_id"])
    messages = waiting.select(
        "blob_path",
        F.lit(container).alias("container_name"),
        "user_id",
        "source",
        path_upload_id("blob_path").alias("upload_id"),
        "correlation_id",
        F.lit("").alias("content_type"),
        F.lit(0).cast("bigint").alias("file_size_bytes"),
    )
    counter = Observation()
    counted = to_queue(messages).observe(counter, F.count(F.lit(1)).alias("n"))
    counted.write.mode("append").parquet(queue_path)
    return counter.get["n"]


def start_processing(
    spark, queue_path, store, checkpoint, results, max_files=None, every=None, **options
):
    """Process queue files not seen before into the store; `options` as for `process_into`."""
    reader = spark.readStream.schema("value string").format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (
        reader.load(queue_path)
        .writeStream.foreachBatch(process_into(store, results, **options))
        .option("checkpointLocation", checkpoint)
    )
    return with_trigger(writer, every).start()
