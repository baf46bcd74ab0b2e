"""Parameterised reports over the invoice table: summaries, dashboard, lists and details."""

from pyspark.sql import functions as F

from ledgerloom.functions.display import flag_label, money_text, percent_text
from ledgerloom.functions.money import money_sum
from ledgerloom.functions.normalize import present, text_or
from ledgerloom.operators.medallion import anomaly_count

# Thresholds, page sizes and the fields an invoice must have.
REVIEW_CONFIDENCE = 0.90
PAGE_SIZE, MAX_PAGE_SIZE = 50, 200
RECENT, FLAGGED = 10, 20
REQUIRED_FIELDS = {
    "VendorName": "vendor_name",
    "InvoiceId": "invoice_number",
    "InvoiceTotal": "total_amount",
}
STORE_COLUMNS = ["_rid", "_self", "_etag", "_attachments", "_ts"]


def of_user(df, user_id):
    """Rows of one user, or of all users when no user is given."""
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def spend_summary(df, user_id, group_by="category", start_date="", end_date=""):
    """Count and total of processed invoices per category, vendor or month.

    The range is inclusive and compares text, as the dates are stored: a blank date passes an end
    date alone and fails a start date. Any other `group_by` means category.
    """
    rows = of_user(df, user_id).filter(F.col("status") == "processed")
    if start_date:
        rows = rows.filter(F.col("invoice_date") >= start_date)
    if end_date:
        rows = rows.filter(F.col("invoice_date") <= end_date)
    label = {
        "vendor": F.col("vendor_name"),
        "month": F.substring("invoice_date", 1, 7),
    }.get(group_by, F.col("spend_category"))
    return rows.groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("count"), money_sum("total_amount").alias("total")
    )


def dashboard_totals(df, user_id):
    """The three dashboard figures in one pass. Flagged invoices count in any status."""
    processed = F.col("status") == "processed"
    return of_user(df, user_id).agg(
        F.count_if(processed).alias("total_invoices"),
        F.coalesce(money_sum(F.when(processed, F.col("total_amount"))), F.lit(0.0)).alias(
            "total_spend"
        ),
        F.count_if(anomaly_count() > 0).alias("anomaly_count"),
    )


def dashboard_by_category(df, user_id):
    return spend_summary(df, user_id, "category")


def category_share(df, user_id):
    """Each category's part of the total spend, and the label the chart shows."""
    by_category = dashboard_by_category(df, user_id)
    total = by_category.agg(money_sum("total").alias("all")).scalar()
    share = F.try_divide(F.col("total"), total)
    return by_category.withColumn("share", share).withColumn(
        "share_label", F.concat(F.col("label"), F.lit(" ("), percent_text("share"), F.lit(")"))
    )


def _latest_first(df):
    return df.orderBy(F.col("processed_at").desc_nulls_last(), F.col("id"))


def list_invoices(df, user_id, offset=0, limit=PAGE_SIZE, after=None):
    """One page of a user's invoices, latest first, ties by id.

    `offset` keeps `offset + limit` rows in every task. For pages far down pass the last row seen,
    `after=(processed_at, id)`, instead: the page then starts behind it and costs `limit` rows.
    """
    if offset < 0 or not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"offset must not be negative, limit must be 1 to {MAX_PAGE_SIZE}")
    rows = of_user(df, user_id)
    if after:
        at, last_id = after
        rows = rows.filter(
            (F.col("processed_at") < at)
            | F.col("processed_at").isNull()
            | ((F.col("processed_at") == at) & (F.col("id") > last_id))
        )
    page = _latest_first(rows)
    return (page.offset(offset) if offset else page).limit(limit)


def invoice_lines(page):
    """The short form of listed invoices."""
    return page.select(
        "id",
        F.col("vendor_name").alias("vendor"),
        F.col("total_amount").alias("amount"),
        F.col("spend_category").alias("category"),
        F.col("invoice_date").alias("date"),
        "status",
    )


def recent_invoices(df, user_id):
    return (
        _latest_first(of_user(df, user_id))
        .limit(RECENT)
        .select("id", "vendor_name", "total_amount", "spend_category", "invoice_date", "status")
    )


def with_display_defaults(df):
    """Blank cells as the pages show them."""
    shown = {"vendor_name": "Unknown", "spend_category": "N/A", "invoice_date": "N/A",
             "invoice_number": "--"}
    return df.withColumns({c: text_or(c, d) for c, d in shown.items() if c in df.columns})


def detect_anomalies(df, user_id, limit=FLAGGED):
    """The latest flagged invoices of a user."""
    flagged = of_user(df, user_id).filter(F.size("anomaly_flags") > 0)
    return (
        _latest_first(flagged)
        .limit(limit)
        .select(
            "id",
            "vendor_name",
            "total_amount",
            "invoice_date",
            "anomaly_flags",
            "is_likely_duplicate",
            "spend_category",
        )
    )


def invoice_detail(df, invoice_id, user_id):
    """One invoice without the store's own columns; no row when there is none."""
    found = df.filter((F.col("user_id") == user_id) & (F.col("id") == invoice_id)).limit(1)
    return found.drop(*STORE_COLUMNS)


def review_queue(df, threshold=REVIEW_CONFIDENCE):
    """Invoices classified with less confidence than the threshold."""
    return df.filter(F.col("classification_confidence") < threshold)


def missing_fields(df):
    """Invoices that lack a required field, with the names of the missing ones."""
    reasons = []
    for field, column in REQUIRED_FIELDS.items():
        text = df.schema[column].dataType.typeName() == "string"
        there = present(column) if text else F.col(column).isNotNull()
        reasons.append(F.when(~there, F.lit(field)))
    return df.withColumn("missing", F.array_compact(F.array(*reasons))).filter(
        F.size("missing") > 0
    )


def budget_variance(df, budgets, period="month"):
    """Actual against budgeted spend per budget period and department.

    Periods are `2025-01` or `2025-Q1`. A budget for department `all` meets all spend of the
    period, any other one the spend of the category of that name. The variance is in percent of
    the budget, zero where there is no budget.
    """
    date = F.col("invoice_date")
    if period == "quarter":
        quarter = F.ceil(F.substring(date, 6, 2).try_cast("int") / 3).cast("string")
        label = F.concat(F.substring(date, 1, 4), F.lit("-Q"), quarter)
    else:
        label = F.substring(date, 1, 7)
    per_category = (
        df.filter(F.col("status") == "processed")
        .groupBy(label.alias("period"), F.col("spend_category").alias("department"))
        .agg(money_sum("total_amount").alias("actual"))
    )
    # Each category's total counts for its own department and for `all`; the sums are small here.
    departments = F.array_distinct(F.array(F.lit("all"), F.col("department")))
    actual = (
        per_category.withColumn("department", F.explode(F.array_compact(departments)))
        .groupBy("period", "department")
        .agg(money_sum("actual").alias("actual"))
    )
    budget = F.col("budget")
    variance = F.when(budget != 0, (F.col("actual") - budget) / budget * 100)
    return (
        budgets.select("period", "department", F.col("amount").alias("budget"))
        .join(actual, ["period", "department"], "left")
        .withColumn("actual", F.coalesce("actual", F.lit(0.0)))
        .withColumn("variance_pct", F.coalesce(variance, F.lit(0.0)))
    )


def display_table(df):
    """The invoice list as the page prints it."""
    return with_display_defaults(df).select(
        "id",
        "vendor_name",
        "invoice_number",
        money_text("total_amount").alias("amount"),
        money_text("total_amount", "$0.00").alias("dashboard_amount"),
        "spend_category",
        "invoice_date",
        "status",
        flag_label("anomaly_flags").alias("flags"),
        F.when(F.col("is_likely_duplicate"), "Duplicate").otherwise("").alias("duplicate"),
        percent_text("classification_confidence").alias("confidence"),
    )
