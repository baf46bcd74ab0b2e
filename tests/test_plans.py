"""Properties of the physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.operators import gold, medallion, mutations, reports
from ledgerloom.operators.duplicates import duplicate_matches, flag_duplicates, mark_duplicates
from ledgerloom.plans import given
from ledgerloom.sources.tables import materialize
from tests.conftest import DATA, final_plan, first_plan

NO_BROADCAST = {"autoBroadcastJoinThreshold": "-1", "adaptive__autoBroadcastJoinThreshold": "-1"}
LAZY = [
    name
    for name in entry.queries()
    if not name.endswith("_stream") and name not in ("medallion_batch", "landing_incremental")
]


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops(spark, name):
    plan = first_plan(entry.queries()[name](spark, DATA))
    assert "NestedLoop" not in plan
    assert "CartesianProduct" not in plan


def test_copies_are_dropped_before_the_shuffle(spark):
    rows = given.invoices(spark, DATA, "id", "status", "processed_at", "total_amount")
    plan = first_plan(medallion.bronze(rows))
    final, partial = plan.index("1, Final"), plan.index("1, Partial")
    assert final < plan.index("Exchange hashpartitioning(id", final) < partial


def test_few_repeated_ids_move_few_rows(spark):
    rows = given.invoices(spark, DATA, "id", "status", "processed_at", "total_amount")
    plan = first_plan(medallion.bronze(materialize(rows, "raw"), settle=True))
    assert "LeftAnti, BuildRight" in plan
    # The one exchange by id is below the semi-join that keeps the repeated ids' rows.
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.index("LeftSemi, BuildRight")


def silver(spark):
    columns = ["id", "status", "vendor_name", "invoice_date", "due_date", "processed_at",
               "total_amount", "spend_category", "is_likely_duplicate", "anomaly_flags"]
    return medallion.silver(medallion.bronze(given.invoices(spark, DATA, *columns)))


def test_unused_vendor_totals_cost_nothing(spark, conf):
    conf(**NO_BROADCAST)
    plan = first_plan(gold.spend_by_category(silver(spark)))
    assert "_lookup_key" not in plan
    assert "_lookup_key" in first_plan(silver(spark))


def test_reports_read_only_their_columns(spark, conf):
    conf(maxMetadataStringLength="2000")
    rows = materialize(given.invoices(spark, DATA), "invoices")
    plan = first_plan(reports.spend_summary(rows, "user3", start_date="1997-01-01"))
    read = plan.split("ReadSchema: struct<")[1].split(">")[0].split(",")
    assert sorted(c.split(":")[0] for c in read) == [
        "invoice_date", "spend_category", "status", "total_amount", "user_id",
    ]
    assert "EqualTo(user_id,user3)" in plan
    assert "EqualTo(status,processed)" in plan
    assert "GreaterThanOrEqual(invoice_date,1997-01-01)" in plan


def test_pages_use_a_bounded_sort(spark):
    rows = materialize(given.invoices(spark, DATA, "id", "user_id", "processed_at"), "page")
    plan = first_plan(reports.list_invoices(rows, "user3", offset=20, limit=20))
    assert "TakeOrderedAndProject(limit=40" in plan


@pytest.fixture
def skewed(spark, conf, tmp_path):
    """A third of the rows has one vendor, another third has none; tiny limits for skew."""
    path = str(tmp_path / "rows")
    n = F.col("id")
    spark.range(0, 60000, 1, 8).select(
        n.cast("string").alias("id"),
        F.when(n % 3 == 0, "HOT").when(n % 3 == 1, None)
        .otherwise((n % 5000).cast("string")).alias("vendor_name"),
        F.when(n % 2 == 0, (n % 1000).cast("double")).alias("total_amount"),
        F.lit("").alias("invoice_date"),
        F.lit("2024").alias("processed_at"),
        F.lit("x").alias("invoice_number"),
    ).write.parquet(path)
    conf(
        **NO_BROADCAST,
        shuffle__partitions="16",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="10KB",
        adaptive__coalescePartitions__enabled="false",
    )
    return spark.read.parquet(path)


def test_hot_vendors_are_split(skewed):
    rows = skewed.withColumn("vendor_name_clean", F.col("vendor_name"))
    totals = medallion.with_vendor_totals(rows).select("id", "vendor_invoice_count")
    assert "skew=true" in final_plan(totals)
    assert totals.filter("vendor_invoice_count = 20000").count() == 40000


def test_hot_duplicate_keys_are_split(skewed):
    marked = mark_duplicates(skewed).select("id", "has_earlier_match")
    assert "skew=true" in final_plan(marked)


def test_changes_to_a_hot_key_are_split(skewed, spark):
    # Copies of one invoice are a third of the table.
    stored = skewed.select(
        F.when(F.col("vendor_name") == "HOT", "HOT").otherwise(F.col("id")).alias("id"),
        F.lit("u").alias("user_id"),
        F.sha2("id", 256).alias("notes"),
    )
    edits = spark.createDataFrame([("HOT", "u", "seen")], "id string, user_id string, notes string")
    updated = mutations.apply_page_edits(stored, edits)
    assert "skew=true" in final_plan(updated)
    assert updated.filter("notes = 'seen'").count() == 20000
    kept = mutations.apply_deletes(stored, edits.select("id", "user_id"))
    assert "skew=true" in final_plan(kept)
    assert kept.count() == 40000


def test_matches_keep_few_rows_per_key(skewed):
    matches = duplicate_matches(skewed, limit=5)
    plan = first_plan(matches)
    assert "row_number(), 5, Partial" in plan
    assert matches.groupBy("id").count().agg(F.max("count")).first()[0] == 5


def test_settled_totals_are_broadcast_without_moving_the_rows(spark):
    rows = materialize(
        given.invoices(spark, DATA, "id", "vendor_name", "total_amount")
        .withColumnRenamed("vendor_name", "vendor_name_clean"),
        "rows",
    )
    plan = first_plan(medallion.with_vendor_totals(rows, settle=True))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan


def test_a_small_batch_only_scans_the_stored_invoices(spark, conf):
    columns = ["id", "vendor_name", "total_amount", "invoice_date", "processed_at"]
    stored = materialize(given.invoices(spark, DATA, *columns), "stored")
    batch = materialize(stored.filter("total_amount > 450000"), "batch")
    plans = {}

    def settle(df, name):
        plans[name] = first_plan(df)
        return materialize(df, name)

    marked = mark_duplicates(batch, stored, settle)
    filed = plans["first-of-key"]
    semi = filed[filed.index("LeftSemi"):]
    assert "BroadcastHashJoin" in filed[: filed.index("LeftSemi")].splitlines()[-1]
    # The first side of the semi-join, the stored rows, reaches it without an exchange.
    assert semi.index("FileScan") < semi.index("Exchange")
    assert "Exchange hashpartitioning" not in first_plan(marked)


def test_few_duplicates_leave_whole_rows_in_place(spark):
    columns = ["id", "vendor_name", "total_amount", "invoice_date", "processed_at", "raw_text",
               "is_likely_duplicate", "anomaly_flags"]
    rows = materialize(given.invoices(spark, DATA, *columns), "rows")
    plan = first_plan(flag_duplicates(rows, settle=True))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan


def test_wider_keys_pass_a_semi_join_before_they_are_grouped(spark):
    """Every invoice is filed under its full key; the others only where somebody asks with them."""
    columns = ["id", "vendor_name", "total_amount", "invoice_date", "processed_at"]
    rows = materialize(given.invoices(spark, DATA, *columns), "rows")
    plans = {}

    def settle(df, name):
        plans[name] = first_plan(df)
        return materialize(df, name)

    mark_duplicates(rows, settle=settle)
    filed = plans["first-of-key"]
    # Of the two branches of the union, one explodes the full key only, the other meets the semi-join.
    wide = filed[filed.index("LeftSemi"):]
    assert "LeftSemi" in filed and "Union" in filed[: filed.index("LeftSemi")]
    assert "Generate" in filed[filed.index("Union"): filed.index("LeftSemi")]
    assert "Generate" in wide
