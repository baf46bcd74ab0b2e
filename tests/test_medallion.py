"""Landing, bronze, silver, gold and the batch job."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import gold, medallion
from ledgerloom.operators.lookup import with_group_values
from ledgerloom.plans import given
from ledgerloom.plans.medallion_job import run_medallion
from ledgerloom.schemas import INVOICE
from ledgerloom.session import work_path
from ledgerloom.sources.tables import materialize, read_table
from tests.conftest import DATA, first_plan


def invoice_rows(spark, *rows):
    """Invoice records from dictionaries; what is not given is null."""
    return spark.createDataFrame(
        [tuple(row.get(c) for c in INVOICE.names) for row in rows], INVOICE
    )


def row(id, **values):
    return {
        "id": id,
        "user_id": "u",
        "status": "processed",
        "processed_at": "2024-01-01T00:00:00+00:00",
        **values,
    }


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_bronze_keeps_processed_rows_and_tolerates_bad_values(spark):
    raw = invoice_rows(
        spark,
        row("1", vendor_name="  acme ", invoice_date="2024-02-03", due_date="", currency=None),
        row("2", invoice_date="Jan 5", due_date="2024-03-01", currency="eur", processed_at="x"),
        row("3", status="failed"),
        row("4", status=None),
    )
    got = by_id(medallion.bronze(raw))
    assert set(got) == {"1", "2"}
    assert got["1"]["vendor_name_clean"] == "ACME"
    assert str(got["1"]["invoice_date_parsed"]) == "2024-02-03"
    assert got["1"]["due_date_parsed"] is None
    assert got["1"]["currency"] == "USD"
    assert got["2"]["invoice_date_parsed"] is None
    assert got["2"]["processed_at_ts"] is None
    assert got["2"]["currency"] == "EUR"


def test_deduplication_keeps_the_latest_whatever_the_order(spark):
    rows = [
        row("1", processed_at="2024-01-01T00:00:00+00:00", notes="old"),
        row("1", processed_at="2024-01-02T00:00:00+00:00", notes="new"),
        row("1", processed_at="", notes="undated"),
        row("2", notes="a"),
        row("2", notes="b"),
    ]
    rows.append(row("3", notes="single"))
    one = medallion.bronze(invoice_rows(spark, *rows))
    assert by_id(one)["1"]["notes"] == "new"
    for settle in (False, True):
        other = medallion.bronze(invoice_rows(spark, *reversed(rows)).repartition(3), settle)
        assert other.count() == 3
        assert by_id(other) == by_id(one)


def test_few_and_many_repeated_ids_take_one_plan(spark, conf):
    rows = invoice_rows(spark, *[row(str(n // 2), notes=str(n)) for n in range(40)])
    few = medallion.bronze(rows, settle=True)
    conf(autoBroadcastJoinThreshold="-1")
    many = medallion.bronze(rows, settle=True)
    for plan in (first_plan(few), first_plan(many)):
        assert "LeftAnti" in plan and "LeftSemi" in plan
    assert few.count() == many.count() == 20
    assert by_id(few) == by_id(many)


@pytest.mark.parametrize("settle", [False, True])
def test_silver_scores(spark, settle):
    raw = invoice_rows(
        spark,
        *[row(str(i), vendor_name="a", total_amount=10.0) for i in range(9)],
        row("big", vendor_name=" A ", total_amount=1000.0, anomaly_flags=["x", "y"],
            invoice_date="2024-05-06", due_date="2024-05-16"),
        row("n1", total_amount=5.0),
        row("n2"),
    )
    got = by_id(medallion.silver(medallion.bronze(raw), settle))
    big = got["big"]
    assert (big["vendor_invoice_count"], big["vendor_total_spend"]) == (10, 1090.0)
    assert big["is_high_value"] is True
    assert (big["fiscal_period"], big["days_to_due"], big["anomaly_count"]) == ("2024-Q2", 10, 2)
    assert got["0"]["is_high_value"] is False
    # Invoices without a vendor are one group, as in a window.
    assert (got["n2"]["vendor_invoice_count"], got["n2"]["vendor_avg_amount"]) == (2, 5.0)
    assert got["n2"]["is_high_value"] is False
    assert got["n2"]["fiscal_period"] is None
    assert got["n2"]["anomaly_count"] == 0


def test_group_values_equal_a_window(spark):
    from pyspark.sql import Window

    rows = spark.range(2000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string"))
        .alias("k"),
    )
    window = Window.partitionBy("k")
    expected = rows.withColumn("n", F.count("id").over(window))
    got = with_group_values(rows, ["k"], n=F.count("id"))
    assert got.select("id", "k", "n").exceptAll(expected).count() == 0
    assert got.count() == 2000


def test_gold_totals_equal_silver(spark):
    columns = ["id", "status", "vendor_name", "invoice_date", "due_date", "processed_at",
               "total_amount", "spend_category", "is_likely_duplicate", "anomaly_flags"]
    silver = medallion.silver(medallion.bronze(given.invoices(spark, DATA, *columns))).cache()
    n = silver.count()
    for table in ("spend_by_category", "vendor_analysis", "monthly_trend"):
        built = gold.GOLD_TABLES[table](silver)
        assert built.agg(F.sum("invoice_count")).first()[0] == n
    exact = gold.monthly_trend(silver).count()
    assert gold.monthly_trend(silver, approximate_vendors=True).count() == exact
    amounts = [r[0] for r in gold.ordered(gold.anomaly_summary(silver), "anomaly_summary")
               .select("total_amount").collect()]
    known = [a for a in amounts if a is not None]
    assert known == sorted(known, reverse=True)
    assert amounts[len(known):] == [None] * (len(amounts) - len(known))
    silver.unpersist()


def test_audit_columns(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    from_file = medallion.with_audit_columns(spark.read.parquet(path)).collect()
    assert all(path in r["_source_file"] and r["_ingested_at"] for r in from_file)
    rows = spark.createDataFrame([(1,)], "a int")
    no_file = medallion.with_audit_columns(rows, from_files=False).first()
    assert no_file["_source_file"] is None


def test_batch_job_counts_what_it_writes_and_can_run_again(spark):
    base = work_path(spark, "job")
    rows = materialize(given.invoices(spark, DATA), "store")
    done = run_medallion(spark, rows, base)
    assert list(done) == ["raw_invoices", "invoices_bronze", "invoices_silver", *gold.GOLD_TABLES]
    for path, count in done.values():
        assert read_table(spark, path).count() == count
    landed = read_table(spark, done["raw_invoices"][0])
    assert landed.filter("_source_file is null").count() == 0
    again = run_medallion(spark, rows.filter("user_id = 'user3'"), base)
    assert 0 < again["raw_invoices"][1] < done["raw_invoices"][1]
    assert read_table(spark, again["raw_invoices"][0]).count() == again["raw_invoices"][1]


def test_batch_job_moves_no_whole_rows_and_leaves_only_its_zones(spark, conf):
    """Vendors and repeated ids beyond Spark's own limit for broadcasts are sent out all the same."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(work_path(spark, "x")).getParent()
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    notes = [row(str(n // 2), vendor_name=f"v{n % 50}", notes=str(n)) for n in range(400)]
    rows = materialize(invoice_rows(spark, *notes), "store")
    conf(autoBroadcastJoinThreshold="100")
    plan = first_plan(medallion.silver(medallion.bronze(rows, settle=True), settle=True))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
    before, kept = shuffles.size(), {s.getPath().getName() for s in files.listStatus(folder)}
    done = run_medallion(spark, rows, work_path(spark, "zones"), from_files=False)
    assert done["invoices_silver"][1] == 200
    left = {s.getPath().getName().split("-")[0] for s in files.listStatus(folder) if s.getPath().getName() not in kept}
    assert left == {"zones"} and shuffles.size() <= before
    assert all(f.endswith(".zstd.parquet") for f in read_table(spark, done["raw_invoices"][0]).inputFiles())
