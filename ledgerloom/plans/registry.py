"""The registered queries: name to a function of session and data folder.

Each reads the given tables whole. Arrays and dates are shown as text so that results compare value
by value with the SQL statements in `oracle.py`.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import intake as intake_rules
from ledgerloom.functions.money import money_sum
from ledgerloom.functions.normalize import (
    clean_vendor,
    document_id,
    normalize_currency,
    parse_float,
)
from ledgerloom.operators import (
    changes,
    classification,
    duplicates,
    extraction,
    gold,
    medallion,
    mutations,
    reports,
    search,
)
from ledgerloom.operators.latest import first_per_key
from ledgerloom.operators.text_index import TextIndex
from ledgerloom.operators.vector_index import VectorIndex
from ledgerloom.plans import given
from ledgerloom.plans.given import CONTAINER, invoices
from ledgerloom.plans.incremental_gold import IncrementalGold, gold_between
from ledgerloom.plans.medallion_job import run_medallion
from ledgerloom.schemas import INVOICE
from ledgerloom.session import work_path
from ledgerloom.sources import files, tables
from ledgerloom.streaming import intake, landing, processing

USER = "user3"
SEARCH_QUERY = "theron ouan sharon: eneux"
MONEY_TEXTS = ["plain", "blank", "thousands", "exponent", "suffix", "sign"]

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def joined(c):
    """A list of texts as one text; null stays null."""
    return F.array_join(F.col(c), ",").alias(c)


def day(c):
    return F.col(c).cast("string").alias(c)


# Store, landing, bronze, silver -------------------------------------------------------------------


@query
def scan_invoices(spark, sf_dir):
    path = work_path(spark, "store")
    invoices(spark, sf_dir).write.parquet(path)
    rows = tables.scan_invoices(spark, path)
    flat = [
        joined(c) if c in ("anomaly_flags", "tags") else F.col(c)
        for c in INVOICE.names
        if c not in ("line_items", "raw_text")
    ]
    return rows.select(
        *flat,
        F.size("line_items").alias("item_count"),
        F.md5("raw_text").alias("text_md5"),
    )


@query
def landing_audit(spark, sf_dir):
    orders = medallion.with_audit_columns(given.table(spark, sf_dir, "orders"))
    return orders.select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        F.substring_index("_source_file", "/", -1).alias("source_file"),
        F.col("_ingested_at").isNotNull().alias("has_time"),
    )


BRONZE_INPUT = [
    "id", "user_id", "status", "vendor_name", "invoice_date", "due_date", "processed_at",
    "total_amount", "subtotal", "total_tax", "currency",
]


def _bronze_columns():
    return [
        "id",
        "user_id",
        "vendor_name_clean",
        day("invoice_date_parsed"),
        day("due_date_parsed"),
        F.unix_seconds("processed_at_ts").alias("processed_at_seconds"),
        "total_amount",
        "subtotal",
        "total_tax",
        "currency",
    ]


@query
def bronze(spark, sf_dir):
    return medallion.bronze(invoices(spark, sf_dir, *BRONZE_INPUT)).select(_bronze_columns())


@query
def bronze_dedup(spark, sf_dir):
    rows = medallion.cleanse(invoices(spark, sf_dir, "id", "status", "processed_at", "user_id"))
    kept = medallion.deduplicate(rows)
    before = rows.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return kept.join(before, "id").select("id", "user_id", "processed_at", "copies")


SILVER_INPUT = [
    "id", "status", "vendor_name", "invoice_date", "due_date", "processed_at", "total_amount",
    "spend_category", "is_likely_duplicate", "anomaly_flags",
]


def _silver(spark, sf_dir):
    """Silver in one plan; the vendor totals drop out where no column of theirs is used."""
    return medallion.silver(medallion.bronze(invoices(spark, sf_dir, *SILVER_INPUT)))


@query
def silver(spark, sf_dir):
    return _silver(spark, sf_dir).select(
        "id",
        "vendor_name_clean",
        "fiscal_year",
        "fiscal_quarter",
        "fiscal_month",
        "fiscal_period",
        "anomaly_count",
        "is_high_value",
        "days_to_due",
    )


@query
def silver_vendor_window(spark, sf_dir):
    return _silver(spark, sf_dir).select(
        "id",
        "vendor_name_clean",
        "vendor_invoice_count",
        "vendor_total_spend",
        "vendor_avg_amount",
    )


@query
def spend_by_category(spark, sf_dir):
    return gold.spend_by_category(_silver(spark, sf_dir))


@query
def vendor_analysis(spark, sf_dir):
    result = gold.vendor_analysis(_silver(spark, sf_dir))
    dates = ["first_invoice_date", "last_invoice_date"]
    return result.withColumns({c: F.col(c).cast("string") for c in dates})


@query
def monthly_trend(spark, sf_dir):
    return gold.monthly_trend(_silver(spark, sf_dir))


@query
def anomaly_summary(spark, sf_dir):
    result = gold.anomaly_summary(_silver(spark, sf_dir))
    return result.withColumns(
        {
            "invoice_date_parsed": F.col("invoice_date_parsed").cast("string"),
            "anomaly_flags": F.array_join("anomaly_flags", ","),
        }
    )


@query
def medallion_batch(spark, sf_dir):
    """The whole batch job, written zone by zone: what the written tables hold. Zone tables show count
    and amount per user or vendor, gold tables each of their rows; `counted` says whether the write
    counted the rows that a reader finds."""
    rows = invoices(spark, sf_dir)
    done = run_medallion(spark, rows, work_path(spark, "zones"), from_files=False)
    shown = {
        "raw_invoices": ("total_amount", None, ["user_id"]),
        "invoices_bronze": ("total_amount", None, ["user_id"]),
        "invoices_silver": ("total_amount", None, ["vendor_name_clean"]),
        "spend_by_category": (
            "total_spend", "invoice_count", ["fiscal_year", "fiscal_month", "spend_category"],
        ),
        "vendor_analysis": ("total_spend", "invoice_count", ["vendor_name_clean", "spend_category"]),
        "monthly_trend": ("total_spend", "invoice_count", ["fiscal_year", "fiscal_month"]),
        "anomaly_summary": ("total_amount", "anomaly_count", ["id"]),
    }
    parts = []
    for name, (path, counted) in done.items():
        amount, number, keys = shown[name]
        table = tables.read_table(spark, path)
        key = F.concat_ws("|", *keys).alias("key")
        if number is None:
            held = table.groupBy(key).agg(
                F.count(F.lit(1)).alias("number"), money_sum(amount).alias("amount")
            )
        else:
            number = F.col(number).cast("bigint").alias("number")
            held = table.select(key, number, F.col(amount).alias("amount"))
        found = table.agg(F.count(F.lit(1))).scalar()
        parts.append(
            held.select(F.lit(name).alias("table_name"), "*", (found == counted).alias("counted"))
        )
    return reduce(DataFrame.unionByName, parts)


@query
def gold_ordered(spark, sf_dir):
    """Spend by category in report order, with the place of each row."""
    rows = gold.ordered(gold.spend_by_category(_silver(spark, sf_dir)), "spend_by_category")
    return _placed(rows).select(
        "place", "fiscal_year", "fiscal_month", "spend_category", "invoice_count"
    )


@query
def gold_ordered_by_spend(spark, sf_dir):
    """The vendors' totals from the largest down."""
    rows = gold.ordered(gold.vendor_analysis(_silver(spark, sf_dir)), "vendor_analysis")
    return _placed(rows).select("place", "total_spend")


def _placed(rows):
    """Number the rows of a sorted report, in the order they come: each sorted range starts where the
    ranges before it end."""
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = tables.materialize(rows, "placed")
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "_range").withColumn("place", F.col("start") + F.col("_row") + 1)


def _versions(spark, sf_dir):
    """Two versions of the invoice store. The first has other amounts and categories for every fifth
    order, lacks every seventh, and has invoices that the second lacks."""
    now = first_per_key(invoices(spark, sf_dir, *SILVER_INPUT), ["id"], ["processed_at"])
    now = tables.materialize(now, "v2")
    k = F.substring_index("id", "-", 1).cast("bigint")
    was = now.filter(k % 7 != 0).withColumns(
        {
            "total_amount": F.when(k % 5 == 1, F.col("total_amount") * 3 + 50).otherwise(F.col("total_amount")),
            "spend_category": F.when(k % 5 == 1, F.lit("Other")).otherwise(F.col("spend_category")),
        }
    )
    gone = now.filter(k % 11 == 2).withColumn("id", F.concat(F.lit("gone-"), "id"))
    return tables.materialize(was.unionByName(gone), "v1"), now


def _incremental_gold(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    kept = IncrementalGold(spark, work_path(spark, "gold"))
    kept.apply(old)
    return gold_between(old, new, kept)


@query
def change_feed(spark, sf_dir):
    """What changed between two versions of the store."""
    feed = changes.change_feed(*_versions(spark, sf_dir))
    return feed.select("id", "_change", "total_amount", "spend_category")


@query
def gold_incremental(spark, sf_dir):
    """Gold tables built from one version of the store and brought to the next by its change feed."""
    kept = _incremental_gold(spark, sf_dir)
    shown = {
        "spend_by_category": (
            kept.spend_by_category(), ["fiscal_year", "fiscal_month", "spend_category"],
            {"low": "min_invoice_amount", "high": "max_invoice_amount", "average": "avg_invoice_amount",
             "duplicates": "duplicate_count", "flags": "total_anomaly_flags"},
        ),
        "vendor_analysis": (
            kept.vendor_analysis(), ["vendor_name_clean", "spend_category"],
            {"average": "avg_invoice_amount", "duplicates": "duplicate_count", "days": "avg_days_to_due",
             "first": "first_invoice_date", "last": "last_invoice_date"},
        ),
        "monthly_trend": (
            kept.monthly_trend(), ["fiscal_year", "fiscal_month"],
            {"flags": "total_anomalies", "vendors": "unique_vendors"},
        ),
    }
    kinds = {
        "low": "double", "high": "double", "average": "double", "duplicates": "bigint", "flags": "bigint",
        "days": "double", "first": "string", "last": "string", "vendors": "bigint",
    }
    parts = [
        rows.select(
            F.lit(name).alias("table_name"), F.concat_ws("|", *keys).alias("key"),
            "invoice_count", "total_spend",
            *[(F.col(own[c]) if c in own else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()],
        )
        for name, (rows, keys, own) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def gold_incremental_anomalies(spark, sf_dir):
    result = _incremental_gold(spark, sf_dir).anomaly_summary()
    return result.withColumns(
        {
            "invoice_date_parsed": F.col("invoice_date_parsed").cast("string"),
            "anomaly_flags": F.array_join("anomaly_flags", ","),
        }
    )


# Reports ------------------------------------------------------------------------------------------

REPORT_INPUT = [
    "id", "user_id", "status", "vendor_name", "total_amount", "spend_category", "invoice_date",
    "processed_at", "anomaly_flags", "is_likely_duplicate",
]


def _spend(spark, sf_dir, label, **options):
    columns = ["user_id", "status", "total_amount", "invoice_date", label]
    rows = invoices(spark, sf_dir, *dict.fromkeys(columns))
    return reports.spend_summary(rows, USER, **options)


@query
def spend_summary_category(spark, sf_dir):
    return _spend(spark, sf_dir, "spend_category")


@query
def spend_summary_vendor(spark, sf_dir):
    return _spend(spark, sf_dir, "vendor_name", group_by="vendor")


@query
def spend_summary_month(spark, sf_dir):
    return _spend(spark, sf_dir, "invoice_date", group_by="month")


@query
def spend_summary_range(spark, sf_dir):
    return _spend(
        spark, sf_dir, "spend_category", start_date="1996-01-15", end_date="1998-06-30"
    )


@query
def dashboard_totals(spark, sf_dir):
    rows = invoices(spark, sf_dir, "user_id", "status", "total_amount", "anomaly_flags")
    return reports.dashboard_totals(rows, USER)


@query
def dashboard_by_category(spark, sf_dir):
    rows = invoices(spark, sf_dir, "user_id", "status", "total_amount", "spend_category")
    return reports.dashboard_by_category(rows, None)


@query
def category_share(spark, sf_dir):
    rows = invoices(spark, sf_dir, "user_id", "status", "total_amount", "spend_category")
    return reports.category_share(rows, USER)


@query
def list_invoices(spark, sf_dir):
    rows = invoices(spark, sf_dir, *REPORT_INPUT)
    return reports.invoice_lines(reports.list_invoices(rows, USER, offset=40, limit=20))


@query
def list_invoices_after(spark, sf_dir):
    """The page behind the fifteenth invoice, named by its time and id."""
    rows = invoices(spark, sf_dir, *REPORT_INPUT)
    last = reports.list_invoices(rows, USER, offset=14, limit=1).first()
    page = reports.list_invoices(rows, USER, limit=20, after=(last["processed_at"], last["id"]))
    return reports.invoice_lines(page)


@query
def recent_invoices(spark, sf_dir):
    rows = invoices(spark, sf_dir, *REPORT_INPUT)
    return reports.with_display_defaults(reports.recent_invoices(rows, USER))


@query
def detect_anomalies(spark, sf_dir):
    found = reports.detect_anomalies(invoices(spark, sf_dir, *REPORT_INPUT), USER)
    return found.withColumn("anomaly_flags", F.array_join("anomaly_flags", ","))


@query
def invoice_detail(spark, sf_dir):
    """The user's invoice with the smallest id, in full."""
    columns = [c for c in INVOICE.names if c not in ("line_items", "tags", "raw_text")]
    rows = invoices(spark, sf_dir, *columns).withColumns({"_etag": F.lit("x"), "_ts": F.lit(1)})
    ids = reports.of_user(invoices(spark, sf_dir, "id", "user_id"), USER)
    found = reports.invoice_detail(rows, ids.agg(F.min("id")).scalar(), USER)
    return found.withColumn("anomaly_flags", F.array_join("anomaly_flags", ","))


@query
def review_queue(spark, sf_dir):
    rows = invoices(
        spark, sf_dir, "id", "user_id", "spend_category", "classification_confidence"
    )
    return reports.review_queue(rows)


@query
def missing_fields(spark, sf_dir):
    rows = invoices(spark, sf_dir, "id", "vendor_name", "invoice_number", "total_amount")
    found = reports.missing_fields(rows)
    return found.select("id", F.array_join("missing", ",").alias("missing"))


@query
def budget_variance(spark, sf_dir):
    rows = invoices(spark, sf_dir, "status", "invoice_date", "spend_category", "total_amount")
    return reports.budget_variance(rows, given.budgets(spark, sf_dir))


@query
def budget_variance_quarter(spark, sf_dir):
    rows = invoices(spark, sf_dir, "status", "invoice_date", "spend_category", "total_amount")
    return reports.budget_variance(rows, given.quarter_budgets(spark, sf_dir), period="quarter")


@query
def display_format(spark, sf_dir):
    columns = [*REPORT_INPUT, "invoice_number", "classification_confidence"]
    return reports.display_table(invoices(spark, sf_dir, *columns))


# Duplicates and changes ---------------------------------------------------------------------------

DUPLICATE_INPUT = [
    "id", "vendor_name", "total_amount", "invoice_date", "processed_at", "is_likely_duplicate",
    "anomaly_flags",
]


@query
def duplicate_detection(spark, sf_dir):
    flagged = duplicates.flag_duplicates(invoices(spark, sf_dir, *DUPLICATE_INPUT))
    return flagged.select("id", "processed_at", "is_likely_duplicate", joined("anomaly_flags"))


@query
def duplicate_matches(spark, sf_dir):
    columns = ["id", "vendor_name", "total_amount", "invoice_date", "processed_at",
               "invoice_number"]
    return duplicates.duplicate_matches(invoices(spark, sf_dir, *columns))


@query
def upsert_latest(spark, sf_dir):
    """Invoices above 100,000 are stored as processing, some of them twice, then all final records
    arrive."""
    columns = ["id", "user_id", "processed_at", "status", "total_amount"]
    first = invoices(spark, sf_dir, *columns)
    first = first.filter("total_amount > 100000").withColumns(
        {"status": F.lit("processing"), "total_amount": F.lit(None).cast("double")}
    )
    return mutations.upsert_latest(first, invoices(spark, sf_dir, *columns), settle=True)


@query
def failed_records(spark, sf_dir):
    """Failure records of the messages whose file has no analysis result."""
    messages = intake.accept_events(given.file_events(spark, sf_dir), CONTAINER)
    results = given.stored_results(spark, sf_dir).select("blob_path")
    failed = messages.join(results, "blob_path", "left_anti")
    records = mutations.failure_records(
        failed,
        intake_rules.stable_id("container_name", "blob_path"),
        intake_rules.utc_now_text(),
    )
    iso = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$"
    return records.withColumn("has_time", F.col("processed_at").rlike(iso)).drop("processed_at")


@query
def apply_updates(spark, sf_dir):
    stored = invoices(spark, sf_dir, "id", "user_id", "spend_category", "notes", "status")
    return mutations.apply_page_edits(stored, given.change_set(spark, sf_dir))


@query
def apply_deletes(spark, sf_dir):
    """Delete the failed invoices."""
    stored = invoices(spark, sf_dir, "id", "user_id", "status", "total_amount")
    return mutations.apply_deletes(stored, stored.filter("status = 'failed'"))


# Text and model output ----------------------------------------------------------------------------


@query
def chunk_text(spark, sf_dir):
    texts = given.table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.chunk_text(texts, "text").select(
        "doc_id",
        F.col("chunk_id").cast("bigint").alias("chunk_id"),
        F.char_length("content").cast("bigint").alias("chars"),
        F.md5("content").alias("content_md5"),
    )


SEARCH_INPUT = [
    "id", "raw_text", "vendor_name", "invoice_number", "spend_category", "invoice_date",
    "total_amount", "user_id", "processed_at",
]


def _documents(spark, sf_dir):
    rows = invoices(spark, sf_dir, *SEARCH_INPUT)
    return search.search_documents(rows, sequence="processed_at")


@query
def search_documents(spark, sf_dir):
    return _documents(spark, sf_dir).withColumn("content", F.md5("content"))


@query
def search_invoices(spark, sf_dir):
    return search.search_invoices(_documents(spark, sf_dir), SEARCH_QUERY)


@query
def index_write(spark, sf_dir):
    """All documents are indexed, then every fifth order again with a text cut short."""
    path = work_path(spark, "index")
    tables.write_index(_documents(spark, sf_dir), path)
    tables.write_index(_cut_documents(invoices(spark, sf_dir, *SEARCH_INPUT)), path)
    return tables.read_index(spark, path).withColumn("content", F.md5("content"))


def _cut_documents(rows, settle=False):
    fifth = F.substring_index("id", "-", 1).cast("bigint") % 5 == 0
    again = search.cut_stored_text(rows.filter(fifth), 100)
    return search.search_documents(again, sequence="processed_at", settle=settle)


def _text_index(spark, sf_dir):
    """All documents, then every fifth order again with a text cut short, as segments of an index. Both
    come from one stored table of invoices, so that texts are not moved to find an id's latest row."""
    index = TextIndex(spark, work_path(spark, "text-index"))
    with tables.scratch(spark) as keep:
        rows = keep(invoices(spark, sf_dir, *SEARCH_INPUT), "search-input")
        index.put(search.search_documents(rows, sequence="processed_at", settle=keep))
        index.put(_cut_documents(rows, settle=keep))
    return index


@query
def search_indexed(spark, sf_dir):
    return _text_index(spark, sf_dir).search(SEARCH_QUERY)


@query
def search_index_documents(spark, sf_dir):
    """What the index holds after the second delivery."""
    return _text_index(spark, sf_dir).rows().withColumn("content", F.md5("content"))


@query
def stored_text_cut(spark, sf_dir):
    rows = search.cut_stored_text(invoices(spark, sf_dir, "id", "raw_text"))
    return rows.select(
        "id", F.md5("raw_text").alias("text_md5"), F.char_length("raw_text").cast("bigint").alias("chars")
    )


def _label_centres(vectors):
    """Mean vector per label, as query vectors."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("decimal(18,9)")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("i", F.col("m").cast("double").alias("m"))))
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered["m"].alias("vector"))


@query
def vector_topk(spark, sf_dir):
    vectors = given.table(spark, sf_dir, "embeddings")
    found = search.vector_topk(vectors, _label_centres(vectors), 10, "vec_id", "embedding")
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query
def vector_topk_ivf(spark, sf_dir):
    """The same queries as `vector_topk`, answered by an index of all vectors."""
    vectors = given.table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, work_path(spark, "vector-index")).build(vectors, "vec_id", "embedding")
    found = index.search(_label_centres(vectors), 10)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query
def extract_fields(spark, sf_dir):
    view = invoices(spark, sf_dir, *given.RESULT_COLUMNS)
    results = given.analysis_results(view).select("id", "result")
    found = extraction.extract_fields(results)
    items = F.transform(
        "line_items",
        lambda x: F.concat_ws(
            ":",
            x["description"],
            x["quantity"].cast("int").cast("string"),
            F.round(x["unit_price"] * 100).cast("bigint").cast("string"),
            F.round(x["amount"] * 100).cast("bigint").cast("string"),
            x["unit"],
            x["product_code"],
        ),
    )
    return found.select(
        "id", "vendor_name", "customer_name", "invoice_number", "invoice_date", "due_date",
        "purchase_order", "total_amount", "subtotal", "total_tax", "currency", "page_count",
        "confidence", "extraction_failed",
        F.md5("raw_text").alias("text_md5"),
        F.array_join(items, "|").alias("items"),
    )


@query
def line_items_flat(spark, sf_dir):
    return extraction.line_items_flat(invoices(spark, sf_dir, "id", "line_items"))


@query
def classification_context(spark, sf_dir):
    columns = [
        "id", "vendor_name", "invoice_number", "invoice_date", "due_date", "total_amount",
        "currency", "subtotal", "total_tax", "purchase_order", "customer_name", "line_items",
        "raw_text",
    ]
    rows = invoices(spark, sf_dir, *columns)
    return rows.select("id", extraction.classification_context().alias("context"))


@query
def parse_classification(spark, sf_dir):
    view = invoices(spark, sf_dir, *given.REPLY_COLUMNS)
    parsed = extraction.parse_classification(given.model_replies(view).select("id", "reply"))
    return parsed.withColumn("anomaly_flags", F.array_join("anomaly_flags", ","))


@query
def classify_rules(spark, sf_dir):
    rows = invoices(spark, sf_dir, "id", "vendor_name", "line_items")
    return classification.classify_with_rules(rows).select("id", "rule_category", "rule_weight")


@query
def classify_learned(spark, sf_dir):
    """All invoices, by what the words of two thirds of them tell about their categories."""
    rows = invoices(spark, sf_dir, "id", "vendor_name", "line_items", "spend_category")
    k = F.substring_index("id", "-", 1).cast("bigint")
    model = classification.learn_categories(rows.filter(F.floor(k / 7) % 3 != 0), settle=True)
    found = classification.classify_learned(rows, model, settle=True)
    return found.select("id", "learned_category", "learned_confidence", "known_words")


@query
def anomaly_rules(spark, sf_dir):
    rows = invoices(
        spark, sf_dir, "id", "vendor_name", "total_amount", "purchase_order", "invoice_date"
    )
    found = classification.anomaly_rules(rows)
    return found.select("id", F.array_join("rule_flags", ",").alias("rule_flags"))


@query
def anomaly_robust(spark, sf_dir):
    """Amounts far out of their vendors' quartiles, from sketches of two halves of the store merged."""
    rows = invoices(spark, sf_dir, "id", "vendor_name", "total_amount")
    rows = rows.withColumn("vendor_name", clean_vendor("vendor_name"))
    half = F.crc32(F.col("id").cast("binary")) % 2 == 0
    halves = [classification.amount_sketches(rows.filter(h)) for h in (half, ~half)]
    sketches = classification.merged_sketches(halves[0].unionByName(halves[1]))
    found = classification.anomaly_robust(rows, sketches)
    return found.select("id", "median_amount", F.round("high_limit", 4).alias("high_limit"), "is_far_out")


@query
def money_parse(spark, sf_dir):
    """Amounts printed in several ways, and currency codes, through the parsing rules."""
    rows = invoices(spark, sf_dir, "id", "total_amount", "currency")
    k = F.substring_index("id", "-", 1).cast("bigint")
    amount = F.col("total_amount").cast("string")
    printed = (
        F.when(k % 6 == 0, amount)
        .when(k % 6 == 1, "")
        .when(k % 6 == 2, F.format_number("total_amount", 2))
        .when(k % 6 == 3, F.concat(F.lit(" "), k.cast("string"), F.lit("e-2\n")))
        .when(k % 6 == 4, F.concat(amount, F.lit("d")))
        .otherwise(F.concat(F.lit("-"), amount))
    )
    return rows.withColumn("printed", printed).select(
        "id",
        parse_float("printed").alias("value"),
        normalize_currency("currency").alias("currency"),
        document_id("id", F.col("currency"), F.lit("a b/c")).alias("document_id"),
    )


# Events and streams -------------------------------------------------------------------------------


@query
def intake_filter(spark, sf_dir):
    events = intake.subscribed(given.file_events(spark, sf_dir), CONTAINER)
    name = intake_rules.blob_name("subject", F.col("data.url"))
    named = events.select("id", name.alias("blob_path"))
    return named.filter(intake_rules.is_supported_file("blob_path"))


@query
def intake_parse(spark, sf_dir):
    return intake.accept_events(given.file_events(spark, sf_dir), CONTAINER)


@query
def upload_accept(spark, sf_dir):
    events = given.file_events(spark, sf_dir)
    path = intake_rules.blob_name("subject", F.col("data.url"))
    uploads = events.select(
        F.col("id").alias("upload_id"),
        F.lit(USER).alias("user_id"),
        F.substring_index(path, "/", -1).alias("filename"),
        F.col("data.contentType").alias("content_type"),
        F.col("data.contentLength").alias("size_bytes"),
    )
    return files.check_uploads(uploads)


def _run(stream):
    stream.awaitTermination()
    return stream


def _write_events(events, path):
    lines = events.select(F.to_json(F.struct("*")).alias("value"))
    lines.write.mode("append").option("compression", "gzip").text(path)


def _start_intake(spark, base):
    return intake.start_intake(
        spark, f"{base}/events", f"{base}/queue", f"{base}/checkpoint", CONTAINER
    )


def _intake_queue(spark, sf_dir):
    base = work_path(spark, "intake")
    _write_events(given.file_events(spark, sf_dir), f"{base}/events")
    _run(_start_intake(spark, base))
    return base


def _processed(spark, sf_dir, results=None):
    """Events to queue to records in two deliveries, the even event ids and then the odd ones, each a
    micro-batch of its own."""
    base = work_path(spark, "intake")
    events = given.file_events(spark, sf_dir)
    if results is None:
        results = tables.materialize(given.stored_results(spark, sf_dir), "results")
    for rest in (0, 1):
        _write_events(events.filter(F.col("id").cast("bigint") % 2 == rest), f"{base}/events")
        _run(_start_intake(spark, base))
        _run(_start_processing(spark, base, results))
    return base


def _start_processing(spark, base, results):
    return processing.start_processing(
        spark, f"{base}/queue", f"{base}/store", f"{base}/process", results
    )


@query
def intake_stream(spark, sf_dir):
    base = _intake_queue(spark, sf_dir)
    return intake.from_queue(spark.read.schema("value string").parquet(f"{base}/queue"))


@query
def landing_incremental(spark, sf_dir):
    """Two deliveries of invoice files, each followed by a run of the landing stream."""
    base = work_path(spark, "incremental")
    rows = invoices(spark, sf_dir)
    early = F.col("processed_at") < "1998-06-01"
    for delivery in (rows.filter(early), rows.filter(~early)):
        delivery.write.mode("append").parquet(f"{base}/files")
        _run(
            landing.start_landing(
                spark, f"{base}/files", f"{base}/landing", f"{base}/checkpoint"
            )
        )
    landed = spark.read.parquet(f"{base}/landing")
    return landed.select(
        "id",
        "user_id",
        "status",
        "processed_at",
        "total_amount",
        (F.col("_ingested_at").isNotNull() & F.col("_source_file").isNotNull()).alias("audited"),
    )


@query
def process_stream(spark, sf_dir):
    """File events to queue to invoice records, every step as a stream, in two deliveries."""
    base = _processed(spark, sf_dir)
    return processing.current_invoices(spark, f"{base}/store").select(
        "id",
        "user_id",
        "source",
        "blob_path",
        "status",
        "vendor_name",
        "invoice_date",
        "total_amount",
        "currency",
        "spend_category",
        "is_likely_duplicate",
        joined("anomaly_flags"),
        "page_count",
    )


@query
def stream_index(spark, sf_dir):
    """The search documents that the stream wrote."""
    base = _processed(spark, sf_dir)
    documents = processing.read_documents(spark, f"{base}/store")
    return documents.select(
        "id", "invoice_id", "chunk_id", F.md5("content").alias("content"), "vendor_name", "user_id"
    )


@query
def stream_retry(spark, sf_dir):
    """At first every third file has no result and fails; when all results are there, the failed
    files are queued again and processed."""
    results = tables.materialize(given.stored_results(spark, sf_dir), "results")
    early = results.filter(F.crc32(F.col("blob_path").cast("binary")) % 3 != 0)
    base = _processed(spark, sf_dir, early)
    processing.retry_failed(spark, f"{base}/store", results, f"{base}/retries", CONTAINER)
    _run(
        processing.start_processing(
            spark, f"{base}/retries", f"{base}/store", f"{base}/retry-checkpoint", results
        )
    )
    return processing.current_invoices(spark, f"{base}/store").select(
        "id", "user_id", "blob_path", "status", "vendor_name", "total_amount"
    )


@query
def intake_malformed(spark, sf_dir):
    """Event files in which every 50th line is broken: what the second sink keeps."""
    base = work_path(spark, "intake")
    events = given.file_events(spark, sf_dir)
    _write_events(events, f"{base}/events")
    broken = events.filter(F.col("id").cast("bigint") % 50 == 3)
    broken.select(F.concat(F.lit("{broken "), "id")).write.mode("append").text(f"{base}/events")
    _run(_start_intake(spark, base))
    _run(intake.start_malformed(spark, f"{base}/events", f"{base}/kept", f"{base}/kept-checkpoint"))
    return spark.read.schema("value string").parquet(f"{base}/kept")


# Files --------------------------------------------------------------------------------------------


@query
def file_listing(spark, sf_dir):
    """A file of supplier names per nation: contents as bytes, and properties."""
    path = work_path(spark, "files")
    suppliers = given.table(spark, sf_dir, "supplier")
    sorted_names = suppliers.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    sorted_names.select("s_name", "s_nationkey").write.partitionBy("s_nationkey").text(path)
    folder = F.regexp_extract("path", "s_nationkey=([0-9]+)", 1).cast("int")
    contents = files.read_files(spark, path, "*.txt").select(
        folder.alias("nation"), F.md5("content").alias("content_md5")
    )
    properties = files.file_properties(spark, path, "*.txt").select(
        F.regexp_extract("name", "s_nationkey=([0-9]+)", 1).cast("int").alias("nation"),
        "size",
        "content_type",
        (F.length("etag") == 32).alias("has_etag"),
    )
    return contents.join(properties, "nation")


EXPORT_INPUT = ["id", "customer_name", "total_amount", "anomaly_flags"]


@query
def export_csv(spark, sf_dir):
    path = work_path(spark, "csv")
    tables.export_data(invoices(spark, sf_dir, *EXPORT_INPUT), path)
    schema = "id string, customer_name string, total_amount double, anomaly_flags string"
    return spark.read.schema(schema).options(header=True, escape='"').csv(path)


@query
def export_json(spark, sf_dir):
    path = work_path(spark, "json")
    tables.export_data(invoices(spark, sf_dir, *EXPORT_INPUT), path, "json")
    schema = "id string, customer_name string, total_amount double, anomaly_flags array<string>"
    return spark.read.schema(schema).json(path).withColumn("anomaly_flags", joined("anomaly_flags"))


@query
def mailbox_filter(spark, sf_dir):
    """Attachments of up to 5 MiB from all senders but one, of two types."""
    events = given.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("User"), F.col("user_id") % 7, F.lit("@x.example")).alias("sender")
    )
    paths = given.file_events(spark, sf_dir).select(
        F.col("id").cast("bigint").alias("event_id"),
        F.substring_index("data.url", "/", -1).alias("filename"),
        F.col("data.contentLength").alias("size_bytes"),
    )
    return files.filter_attachments(
        events.join(paths, "event_id"),
        blocked_senders=["user3@x.example"],
        allowed_types=[".pdf", "png"],
        max_mb=5,
    )
