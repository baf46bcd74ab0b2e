"""Intake, landing and processing as streams."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.intake import subject_prefix
from ledgerloom.schemas import INVOICE
from ledgerloom.session import work_path
from ledgerloom.sources import runs
from ledgerloom.streaming import intake, landing, processing
from tests.conftest import scanned_rows

CREATED = "Microsoft.Storage.BlobCreated"


def event(name, kind=CREATED, **data):
    return {"id": name, "subject": subject_prefix("up") + name, "eventType": kind, "data": data}


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_events_come_alone_or_in_lists(spark):
    rows = lines(
        spark,
        json.dumps(event("u/1/a.pdf", contentType="application/pdf", contentLength=7)),
        json.dumps([event("u/2/a.png"), event("u/3/a.doc"), event("u/4/a.pdf", "Deleted")]),
        "[]",
    )
    events = intake.parse_events(rows)
    assert events.count() == 4
    messages = {r["blob_path"]: r for r in intake.accept_events(events, "up").collect()}
    assert set(messages) == {"u/1/a.pdf", "u/2/a.png"}
    assert messages["u/1/a.pdf"]["file_size_bytes"] == 7
    assert messages["u/2/a.png"]["content_type"] == ""
    assert messages["u/2/a.png"]["file_size_bytes"] == 0
    other = events.withColumn("subject", F.lit(subject_prefix("elsewhere")))
    assert intake.subscribed(other, "up").count() == 0


def test_lines_that_are_no_json_are_kept_apart(spark):
    rows = lines(spark, json.dumps(event("u/1/a.pdf")), "{broken", "[]", "")
    assert intake.parse_events(rows).count() == 1
    assert sorted(r["value"] for r in intake.malformed_events(rows).collect()) == ["", "{broken"]


def test_messages_take_defaults(spark):
    rows = lines(spark, json.dumps({"blob_path": "p", "container_name": "c"}), "{}", "broken")
    (got,) = intake.from_queue(rows).collect()
    assert (got["user_id"], got["source"], got["upload_id"]) == ("system", "upload", "")
    assert got["file_size_bytes"] == 0
    assert intake.malformed(rows).count() == 2


def test_queue_round_trip(spark):
    events = intake.parse_events(lines(spark, json.dumps(event("email/m/a.pdf"))))
    messages = intake.accept_events(events, "up")
    again = intake.from_queue(intake.to_queue(messages))
    assert again.collect() == messages.collect()


def run(query):
    query.awaitTermination()


def test_intake_takes_each_file_once(spark):
    base = work_path(spark, "t")
    for day in ("1", "2"):
        lines(spark, json.dumps(event(f"u/{day}/a.pdf"))).write.mode("append").text(f"{base}/e")
        for _ in range(2):
            run(intake.start_intake(spark, f"{base}/e", f"{base}/q", f"{base}/c", "up"))
    assert spark.read.schema("value string").parquet(f"{base}/q").count() == 2


def test_landing_is_incremental(spark):
    base = work_path(spark, "t")
    for n in range(2):
        rows = spark.createDataFrame([tuple([str(n), *[None] * 30])], INVOICE)
        rows.write.mode("append").parquet(f"{base}/in")
        run(landing.start_landing(spark, f"{base}/in", f"{base}/out", f"{base}/c"))
    landed = spark.read.parquet(f"{base}/out")
    assert sorted(r["id"] for r in landed.collect()) == ["0", "1"]
    assert landed.filter("_source_file is null or _ingested_at is null").count() == 0


def result(vendor, amount, date="2024-01-01", text="words"):
    fields = {
        "VendorName": {"value_string": vendor},
        "InvoiceTotal": {"value_currency": {"amount": amount}},
        "InvoiceDate": {"content": date},
        "CurrencyCode": {"content": " eur"},
    }
    return json.dumps(
        {"content": text, "pages": [{}], "documents": [{"confidence": 1.0, "fields": fields}]}
    )


RESULTS = [
    ("u/1/a.pdf", result("Flight shop", 10.0)),
    ("u/2/a.pdf", result("Flight shop", 10.0)),
    ("u/3/a.pdf", result("Flight shop", 10.0)),
    ("u/4/a.pdf", result("Other shop", 10.0, text="é" * 12000)),
    ("u/5/a.pdf", "{broken"),
]
NOW = "2024-06-01T00:00:00+00:00"


def queue(spark, path, *names):
    events = intake.parse_events(lines(spark, json.dumps([event(n) for n in names])))
    intake.to_queue(intake.accept_events(events, "up")).write.mode("append").parquet(path)


@pytest.fixture
def results(spark):
    return spark.createDataFrame(RESULTS, "blob_path string, result string")


ALL = [f"u/{n}/a.pdf" for n in range(1, 7)]


def current(spark, base):
    return {r["blob_path"]: r for r in processing.current_invoices(spark, f"{base}/store").collect()}


def test_processing_in_batches_equals_one_batch(spark, results):
    base = work_path(spark, "t")
    queue(spark, f"{base}/q", *ALL)
    messages = intake.from_queue(spark.read.schema("value string").parquet(f"{base}/q"))
    classified = processing.extract_messages(messages, results, processed_at=NOW)
    batch = {r["blob_path"]: r for r in processing.finish_records(classified).collect()}
    run(processing.start_processing(
        spark, f"{base}/q", f"{base}/store", f"{base}/c", results, processed_at=NOW))
    assert current(spark, base) == batch

    assert batch["u/4/a.pdf"]["spend_category"] == "Other"
    assert batch["u/4/a.pdf"]["currency"] == "EUR"
    assert len(batch["u/4/a.pdf"]["raw_text"]) == 12000
    trio = [batch[f"u/{n}/a.pdf"] for n in (1, 2, 3)]
    assert {r["spend_category"] for r in trio} == {"Travel"}
    trio.sort(key=lambda r: r["id"])
    assert [r["is_likely_duplicate"] for r in trio] == [False, True, True]
    assert trio[0]["anomaly_flags"] == ["missing_po"]
    assert trio[1]["anomaly_flags"] == ["missing_po", "potential_duplicate"]
    # No result, and a broken one: reduced records.
    for name in ("u/5/a.pdf", "u/6/a.pdf"):
        kept = {c for c, v in batch[name].asDict().items() if v is not None}
        assert kept == set(processing.FAILURE_COLUMNS)
        assert batch[name]["status"] == "failed"


def test_stored_text_can_be_cut(spark, results):
    messages = intake.accept_events(
        intake.parse_events(lines(spark, json.dumps(event("u/4/a.pdf")))), "up"
    )
    classified = processing.extract_messages(messages, results, processed_at=NOW)
    (row,) = processing.finish_records(classified, stored_chars=10000).collect()
    assert len(row["raw_text"]) == 10000


def test_later_batches_see_stored_invoices_and_redelivery_changes_nothing(spark, results):
    base = work_path(spark, "t")

    def process(checkpoint, usable, at):
        run(processing.start_processing(
            spark, f"{base}/q", f"{base}/store", f"{base}/{checkpoint}", usable,
            processed_at=at))

    queue(spark, f"{base}/q", *ALL[:2])
    # The first file has no result yet.
    process("c", results.filter("blob_path <> 'u/1/a.pdf'"), "2024-06-01")
    assert current(spark, base)["u/1/a.pdf"]["status"] == "failed"
    assert current(spark, base)["u/2/a.pdf"]["is_likely_duplicate"] is False

    # Later everything is delivered, some of it again, with an earlier clock.
    queue(spark, f"{base}/q", *ALL, "u/3/a.pdf")
    process("c", results, "2024-05-01")
    second = current(spark, base)
    assert second["u/2/a.pdf"]["processed_at"] == "2024-06-01"
    assert second["u/1/a.pdf"]["status"] == "processed"
    assert second["u/1/a.pdf"]["is_likely_duplicate"] is True
    assert second["u/3/a.pdf"]["is_likely_duplicate"] is True
    assert len(second) == 6

    # A fresh checkpoint replays the whole queue over the same store.
    process("c2", results, "2024-07-01")
    third = current(spark, base)
    done = {k: v for k, v in third.items() if v["status"] == "processed"}
    assert done == {k: v for k, v in second.items() if v["status"] == "processed"}
    assert {k: v["status"] for k, v in third.items()} == {k: v["status"] for k, v in second.items()}

    documents = sorted(r["id"] for r in processing.read_documents(spark, f"{base}/store").collect())
    assert len(documents) == len(set(documents)) and len(documents) >= len(done)
    processing.compact_store(spark, f"{base}/store", f"{base}/new/store")
    assert current(spark, f"{base}/new") == third
    assert processing.read_store(spark, f"{base}/new/store").count() == 6


def test_a_compacted_store_goes_on(spark, results):
    base = work_path(spark, "t")
    queue(spark, f"{base}/q", *ALL[:2])
    run(processing.start_processing(
        spark, f"{base}/q", f"{base}/old", f"{base}/c", results, processed_at="2024-06-01"))
    processing.compact_store(spark, f"{base}/old", f"{base}/store")
    queue(spark, f"{base}/q", *ALL[1:3])
    run(processing.start_processing(
        spark, f"{base}/q", f"{base}/store", f"{base}/c", results, processed_at="2024-06-02"))
    got = current(spark, base)
    assert len(got) == 3 and got["u/2/a.pdf"]["processed_at"] == "2024-06-01"
    assert got["u/3/a.pdf"]["is_likely_duplicate"] is True
    assert processing.read_documents(spark, f"{base}/store").count() == 3


def test_what_a_batch_reads_does_not_grow_with_the_store(spark, monkeypatch):
    """Batches of two files over a store that grows twenty times as large."""
    base = work_path(spark, "t")
    monkeypatch.setattr(runs, "FILE_ROWS", 64)
    monkeypatch.setattr(runs, "PAGE_ROWS", 16)
    names = [f"u/{n}/a.pdf" for n in range(1900)]
    rows = [(n, result(f"Shop {i % 500}", 10.0 + i)) for i, n in enumerate(names)]
    results = spark.createDataFrame(rows, "blob_path string, result string").repartition(1)
    read = []

    def find(table, asked, without=None):
        found = find_rows(table, asked, without)
        read.append(scanned_rows(found))
        return found

    find_rows = runs.RunTable.find
    monkeypatch.setattr(runs.RunTable, "find", find)
    per_batch, at = [], 0
    for size in (90, 2, 1710, 2):
        queue(spark, f"{base}/q", *names[at : at + size])
        at += size
        read.clear()
        run(processing.start_processing(
            spark, f"{base}/q", f"{base}/store", f"{base}/c", results, processed_at=NOW))
        per_batch.append(sum(read))
    assert processing.side_table(spark, f"{base}/store", "_ids").rows().count() == 1804
    assert per_batch[3] <= 3 * 64 * 2 * 6, per_batch  # a file for each key, run and table


def test_high_amounts_are_flagged_against_earlier_batches(spark):
    base = work_path(spark, "t")
    names = [f"u/{n}/a.pdf" for n in range(5)]
    rows = [(n, result("Shop", 10.0 + i)) for i, n in enumerate(names[:4])]
    rows.append((names[4], result("Shop", 999.0)))
    results = spark.createDataFrame(rows, "blob_path string, result string")
    for part in (names[:4], names[4:]):
        queue(spark, f"{base}/q", *part)
        run(processing.start_processing(
            spark, f"{base}/q", f"{base}/store", f"{base}/c", results, processed_at=NOW))
    got = current(spark, base)
    assert got[names[4]]["anomaly_flags"] == ["unusually_high_amount", "missing_po"]
    assert got[names[0]]["anomaly_flags"] == ["missing_po"]


def test_failed_files_are_queued_again_when_their_result_exists(spark, results):
    base = work_path(spark, "t")
    queue(spark, f"{base}/q", *ALL[:3])
    none = results.filter("blob_path = 'u/2/a.pdf'")
    run(processing.start_processing(spark, f"{base}/q", f"{base}/store", f"{base}/c", none))
    usable = results.filter("blob_path <> 'u/3/a.pdf'")
    for expected in (1, 0):
        assert processing.retry_failed(spark, f"{base}/store", usable, f"{base}/r", "up") == expected
        run(processing.start_processing(spark, f"{base}/r", f"{base}/store", f"{base}/rc", usable))
    got = current(spark, base)
    assert {n: r["status"] for n, r in got.items()} == {
        ALL[0]: "processed", ALL[1]: "processed", ALL[2]: "failed",
    }


def test_broken_event_lines_go_to_a_sink_of_their_own(spark):
    base = work_path(spark, "t")
    lines(spark, json.dumps(event("u/1/a.pdf", contentLength=1.5)), "{broken").write.text(f"{base}/e")
    for _ in range(2):
        run(intake.start_intake(spark, f"{base}/e", f"{base}/q", f"{base}/c", "up"))
        run(intake.start_malformed(spark, f"{base}/e", f"{base}/m", f"{base}/mc"))
    kept = spark.read.schema("value string").parquet(f"{base}/m").collect()
    assert [r["value"] for r in kept] == ["{broken"]
    (message,) = intake.from_queue(spark.read.schema("value string").parquet(f"{base}/q")).collect()
    assert message["file_size_bytes"] == 1


def test_malformed_messages_are_kept(spark, results):
    base = work_path(spark, "t")
    queue(spark, f"{base}/q", ALL[0])
    lines(spark, "{broken", '{"blob_path": "p"}').write.mode("append").parquet(f"{base}/q")
    run(processing.start_processing(
        spark, f"{base}/q", f"{base}/store", f"{base}/c", lambda: results))
    assert set(current(spark, base)) == {ALL[0]}
    kept = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/store/_malformed")
    assert sorted(r["value"] for r in kept.collect()) == ['{"blob_path": "p"}', "{broken"]


def test_a_stream_can_keep_running(spark):
    base = work_path(spark, "t")
    lines(spark, json.dumps(event("u/1/a.pdf"))).write.text(f"{base}/e")
    query = intake.start_intake(
        spark, f"{base}/e", f"{base}/q", f"{base}/c", "up", every="1 second"
    )
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert spark.read.schema("value string").parquet(f"{base}/q").count() == 1


def test_classification_by_replies(spark, results):
    replies = spark.createDataFrame(
        [("u/1/a.pdf", '{"spend_category": "HR", "confidence": 0.5}')],
        "blob_path string, reply string",
    )
    events = intake.parse_events(lines(spark, json.dumps([event(n) for n in ALL[:2]])))
    classified = processing.extract_messages(
        intake.accept_events(events, "up"), results, processing.by_replies(replies), NOW
    )
    got = {r["blob_path"]: r for r in processing.finish_records(classified).collect()}
    assert got["u/1/a.pdf"]["spend_category"] == "HR"
    assert got["u/2/a.pdf"]["spend_category"] == ""


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_documents_of_unique_ids_do_not_move(spark):
    from ledgerloom.operators.search import search_documents
    from ledgerloom.schemas import INVOICE

    rows = spark.createDataFrame([{"id": "a", "raw_text": "one"}, {"id": "b", "raw_text": "two"}], INVOICE)
    unique = search_documents(rows, unique=True)
    assert _exchanges(unique) == 0 and _exchanges(search_documents(rows)) == 1
    assert sorted(unique.collect()) == sorted(search_documents(rows).collect())


def test_current_invoices_move_only_what_is_asked(spark, tmp_path, conf):
    """Texts were hashed behind the join by id, so they went along with every row."""
    from ledgerloom.schemas import INVOICE
    from ledgerloom.streaming.processing import current_invoices

    conf(autoBroadcastJoinThreshold="-1")
    rows = [
        {"id": "a", "status": "failed", "processed_at": "1", "raw_text": None},
        {"id": "a", "status": "processed", "processed_at": "2", "raw_text": "long text"},
        {"id": "b", "status": "processed", "processed_at": "1", "raw_text": "other"},
    ]
    spark.createDataFrame(rows, INVOICE).write.parquet(f"{tmp_path}/store/run=x/batch=0")
    found = current_invoices(spark, f"{tmp_path}/store").select("id", "status")
    plan = found._jdf.queryExecution().executedPlan()
    moved = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName() == "Exchange":
            moved.append(node.child().output().mkString(","))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert moved and not any("raw_text" in columns for columns in moved)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "processed"), ("b", "processed")]
