"""Landing, bronze and silver steps."""

from pyspark.sql import functions as F

from ledgerloom.functions.money import money_avg, money_sum
from ledgerloom.functions.normalize import (
    clean_vendor,
    currency_or_usd,
    iso_date,
    iso_timestamp,
)
from ledgerloom.operators.latest import first_per_key, first_per_repeated_key, row_hash
from ledgerloom.operators.lookup import with_group_values


def with_audit_columns(df, from_files=True):
    """Add the time of ingestion and the file each row came from.

    Rows have a file only straight from a file scan; it is null with `from_files` off.
    """
    file = F.col("_metadata.file_path") if from_files else F.lit(None).cast("string")
    return df.withColumns({"_source_file": file, "_ingested_at": F.current_timestamp()})


def cleanse(df):
    """Processed rows with typed dates, amounts, vendor and currency."""
    return df.filter(F.col("status") == "processed").withColumns(
        {
            name: rule
            for name, source, rule in [
                ("invoice_date_parsed", "invoice_date", iso_date("invoice_date")),
                ("due_date_parsed", "due_date", iso_date("due_date")),
                ("processed_at_ts", "processed_at", iso_timestamp("processed_at")),
                ("total_amount", "total_amount", F.col("total_amount").try_cast("double")),
                ("subtotal", "subtotal", F.col("subtotal").try_cast("double")),
                ("total_tax", "total_tax", F.col("total_tax").try_cast("double")),
                ("vendor_name_clean", "vendor_name", clean_vendor("vendor_name")),
                ("currency", "currency", currency_or_usd("currency")),
            ]
            if source in df.columns
        }
    )


def deduplicate(df, settle=False):
    """One row per id: the latest by `processed_at_ts`, ties settled by a hash of the row.

    In one plan every row moves to the task of its id. With `settle`, for stored tables, the ids
    that occur more than once are found from the id column alone and written, and only their rows
    move.
    """
    order = [F.col("processed_at_ts").desc_nulls_last(), row_hash(df)]
    if settle:
        return first_per_repeated_key(df, ["id"], order, settle)
    return first_per_key(df, ["id"], order)


def bronze(df, settle=False):
    """Cleansed rows, one per id (`settle` as in `deduplicate`). Works on any subset of the invoice
    columns that has `id`, `status` and `processed_at`."""
    return deduplicate(cleanse(df), settle)


def with_fiscal_period(df):
    """Calendar year, quarter, month and a `2024-Q1` label, null for rows without a date."""
    day = F.col("invoice_date_parsed")
    return df.withColumns(
        {
            "fiscal_year": F.year(day),
            "fiscal_quarter": F.quarter(day),
            "fiscal_month": F.month(day),
            "fiscal_period": F.concat(
                F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")
            ),
        }
    )


def with_vendor_totals(df, settle=False):
    """Count, sum and average of the vendor's invoices on every row.

    The same figures as three windows over `vendor_name_clean`, in a form that a vendor with a
    large part of all invoices does not slow down.
    """
    return with_group_values(
        df,
        ["vendor_name_clean"],
        settle,
        vendor_invoice_count=F.count("id"),
        vendor_total_spend=money_sum("total_amount"),
        vendor_avg_amount=money_avg("total_amount"),
    )


def anomaly_count():
    return F.coalesce(F.array_size("anomaly_flags"), F.lit(0))


def with_scores(df):
    """Number of flags, the high-value mark and the days until due.

    High value is more than three times the vendor's average. Needs `with_vendor_totals` first.
    """
    high = F.col("total_amount") > F.col("vendor_avg_amount") * 3
    return df.withColumns(
        {
            "anomaly_count": anomaly_count(),
            "is_high_value": F.coalesce(high, F.lit(False)),
            "days_to_due": F.datediff("due_date_parsed", "invoice_date_parsed"),
        }
    )


def silver(df, settle=False):
    """Bronze rows with fiscal period, vendor totals and scores.

    Give `settle` when the bronze rows are a stored table and the vendor columns are wanted.
    """
    return with_scores(with_vendor_totals(with_fiscal_period(df), settle))
