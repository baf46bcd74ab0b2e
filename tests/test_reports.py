"""Reports on hand-written rows."""

import pytest

from ledgerloom.operators import reports

COLUMNS = """id string, user_id string, status string, vendor_name string, total_amount double,
  spend_category string, invoice_date string, processed_at string, anomaly_flags array<string>,
  is_likely_duplicate boolean, invoice_number string, classification_confidence double"""

ROWS = [
    ("1", "u", "processed", "a", 10.0, "IT", "2024-01-05", "5", ["x"], False, "n1", 0.95),
    ("2", "u", "processed", "b", None, "IT", "", "4", [], False, "n2", 0.5),
    ("3", "u", "processed", "a", 30.0, None, "2024-02-01", "4", None, None, None, None),
    ("4", "u", "failed", None, 99.0, "HR", "2024-01-01", "9", ["x", "y"], True, "", 0.9),
    ("5", "v", "processed", "a", 7.0, "IT", "2024-01-01", "8", ["z"], False, "n5", 0.1),
    ("6", "u", None, "c", 1.0, "IT", None, None, [], False, "n6", 0.899),
]


@pytest.fixture
def invoices(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def summary(df):
    return {r["label"]: (r["count"], r["total"]) for r in df.collect()}


def test_spend_summary(invoices):
    assert summary(reports.spend_summary(invoices, "u")) == {"IT": (2, 10.0), None: (1, 30.0)}
    assert summary(reports.spend_summary(invoices, "u", "colour")) == summary(
        reports.spend_summary(invoices, "u", "category")
    )
    assert summary(reports.spend_summary(invoices, "u", "vendor")) == {"a": (2, 40.0), "b": (1, None)}
    assert summary(reports.spend_summary(invoices, "u", "month")) == {
        "2024-01": (1, 10.0), "": (1, None), "2024-02": (1, 30.0),
    }


def test_range_compares_text_and_includes_both_ends(invoices):
    def months(**kw):
        return set(summary(reports.spend_summary(invoices, "u", "month", **kw)))

    assert months(start_date="2024-01-05", end_date="2024-01-05") == {"2024-01"}
    # A blank date passes an end date alone and fails a start date.
    assert months(end_date="2024-01-31") == {"2024-01", ""}
    assert months(start_date="2000-01-01") == {"2024-01", "2024-02"}


def test_dashboard(spark, invoices):
    assert tuple(reports.dashboard_totals(invoices, "u").first()) == (3, 40.0, 2)
    assert tuple(reports.dashboard_totals(invoices, "nobody").first()) == (0, 0.0, 0)
    shares = {r["label"]: r["share"] for r in reports.category_share(invoices, "u").collect()}
    assert shares == {"IT": 0.25, None: 0.75}


def ids(df):
    return [r["id"] for r in df.collect()]


def test_pages(invoices):
    assert ids(reports.list_invoices(invoices, "u")) == ["4", "1", "2", "3", "6"]
    assert ids(reports.list_invoices(invoices, "u", offset=1, limit=2)) == ["1", "2"]
    assert ids(reports.list_invoices(invoices, "u", limit=2, after=("5", "1"))) == ["2", "3"]
    assert ids(reports.list_invoices(invoices, "u", limit=2, after=("4", "2"))) == ["3", "6"]
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            reports.list_invoices(invoices, "u", **bad)
    assert reports.invoice_lines(invoices).columns == [
        "id", "vendor", "amount", "category", "date", "status",
    ]


def test_recent_and_flagged(invoices):
    assert ids(reports.recent_invoices(invoices, "u"))[0] == "4"
    assert ids(reports.detect_anomalies(invoices, "u")) == ["4", "1"]
    assert ids(reports.detect_anomalies(invoices, "u", limit=1)) == ["4"]
    shown = {r["id"]: r for r in reports.with_display_defaults(invoices).collect()}
    assert (shown["4"]["vendor_name"], shown["3"]["spend_category"]) == ("Unknown", "N/A")
    assert (shown["2"]["invoice_date"], shown["4"]["invoice_number"]) == ("N/A", "--")


def test_detail_needs_the_owner(spark, invoices):
    from pyspark.sql import functions as F

    stored = invoices.withColumn("_etag", F.lit("e")).withColumn("_ts", F.lit(1))
    found = reports.invoice_detail(stored, "5", "v")
    assert ids(found) == ["5"]
    assert found.columns == invoices.columns
    assert ids(reports.invoice_detail(stored, "5", "u")) == []


def test_review_and_missing(invoices):
    assert ids(reports.review_queue(invoices).orderBy("id")) == ["2", "5", "6"]
    missing = {r["id"]: r["missing"] for r in reports.missing_fields(invoices).collect()}
    assert missing == {
        "2": ["InvoiceTotal"], "3": ["InvoiceId"], "4": ["VendorName", "InvoiceId"],
    }


@pytest.mark.parametrize(
    ("period", "first", "second"), [("month", "2024-01", "2024-02"), ("quarter", "2024-Q1", "2024-Q2")]
)
def test_budgets(spark, invoices, period, first, second):
    budgets = spark.createDataFrame(
        [(first, "all", 10.0), (first, "IT", 34.0), (first, "HR", 5.0), (second, "all", 0.0),
         ("1999-01", "all", 4.0)],
        "period string, department string, amount double",
    )
    got = {
        (r["period"], r["department"]): (r["actual"], r["variance_pct"])
        for r in reports.budget_variance(invoices, budgets, period).collect()
    }
    in_first = 47.0 if period == "quarter" else 17.0
    assert got[(first, "all")] == (in_first, (in_first - 10) * 10)
    assert got[(first, "IT")] == (17.0, -50.0)
    assert got[(first, "HR")] == (0.0, -100.0)
    assert got[(second, "all")][1] == 0.0
    assert got[("1999-01", "all")] == (0.0, -100.0)


def test_display_table(invoices):
    got = {r["id"]: r for r in reports.display_table(invoices).collect()}
    assert (got["1"]["amount"], got["2"]["amount"], got["2"]["dashboard_amount"]) == (
        "$10.00", "--", "$0.00",
    )
    assert (got["4"]["flags"], got["4"]["duplicate"], got["4"]["confidence"]) == (
        "2 flags", "Duplicate", "90%",
    )
