"""Zone tables, exports and uploaded files."""

import json
import pathlib
from csv import DictReader

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.plans import given
from ledgerloom.schemas import INVOICE
from ledgerloom.sources import files, tables
from tests.conftest import DATA


def test_versions_replace_each_other(spark, tmp_path):
    path = tables.zone_path(str(tmp_path) + "/", "gold", "t")
    assert path == f"{tmp_path}/gold/t"
    assert tables.write_table(spark.range(3), path) == 3
    old = tables.read_table(spark, path)
    # Another schema, and rows read from the version that is replaced.
    assert tables.write_table(old.withColumn("x", F.lit(1)).limit(2), path) == 2
    assert tables.read_table(spark, path).columns == ["id", "x"]
    assert old.count() == 3
    tables.write_table(spark.range(1), path)
    tables.drop_old_versions(spark, path, keep=1)
    assert sorted(p.name for p in (tmp_path / "gold" / "t").iterdir()) == ["v=3"]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3), path)
    with pytest.raises(Exception):
        tables.write_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert tables.read_table(spark, path).count() == 3
    assert tables.write_table(spark.range(5), path) == 5
    assert tables.read_table(spark, path).count() == 5


def test_partitioned_tables_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = given.invoices(spark, DATA, "id", "user_id", "total_amount")
    tables.write_table(rows, path, partition_by=("user_id",))
    one = tables.read_table(spark, path).filter("user_id = 'user3'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_id" in plan
    assert one.count() == rows.filter("user_id = 'user3'").count()


def test_clustered_tables_keep_ranges_apart(spark, conf, tmp_path):
    # Small enough pieces that this small table gets several files.
    conf(adaptive__coalescePartitions__enabled="false")
    path = str(tmp_path / "t")
    rows = given.invoices(spark, DATA, "id", "user_id", "total_amount")
    one_user = rows.withColumn("user_id", F.when(F.col("id") < "5", "big").otherwise(F.col("user_id")))
    tables.write_table(one_user, path, cluster_by=("user_id", "id"))
    ranges, users = [], []
    for part in (tmp_path / "t" / "v=1").glob("*.parquet"):
        got = parquet.read_table(part).select(["user_id", "id"]).to_pylist()
        keys = [(r["user_id"], r["id"]) for r in got]
        assert keys == sorted(keys)
        ranges.append((keys[0], keys[-1]))
        users.append({u for u, _ in keys})
    ranges.sort()
    assert len(ranges) > 1
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sum("big" in u for u in users) > 1
    assert tables.read_table(spark, path).count() == rows.count()


def test_scan_takes_the_declared_schema(spark, tmp_path):
    path = str(tmp_path / "store")
    given.invoices(spark, DATA).drop("notes").write.json(path)
    rows = tables.scan_invoices(spark, path, "json")
    assert rows.schema == INVOICE
    assert rows.filter("notes is not null").count() == 0
    assert rows.count() == 1548


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", 'say "hi",\nok', ["a", "b"]), ("2", None, None)],
        "id string, text string, flags array<string>",
    )
    csv, js = str(tmp_path / "c"), str(tmp_path / "j")
    tables.export_data(rows, csv)
    written = []
    for part in pathlib.Path(csv).glob("*.csv"):
        with part.open(newline="") as lines:
            written += list(DictReader(lines))
    got = {r["id"]: r for r in written}
    assert got["1"]["text"] == 'say "hi",\nok'
    assert json.loads(got["1"]["flags"]) == ["a", "b"]
    assert got["2"]["text"] == ""
    tables.export_data(rows, js, "json")
    assert spark.read.json(js).count() == 2
    with pytest.raises(ValueError):
        tables.export_data(rows, js, "xlsx")


def test_files(spark, tmp_path):
    folder = tmp_path / "up" / "u1"
    folder.mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"%PDF")
    (folder / "b.xyz").write_bytes(b"12")
    contents = {r["path"][-5:]: bytes(r["content"]) for r in files.read_files(spark, str(tmp_path / "up")).collect()}
    assert contents == {"a.pdf": b"%PDF", "b.xyz": b"12"}
    listed = files.file_properties(spark, str(tmp_path / "up"))
    got = {r["name"][-5:]: r for r in listed.collect()}
    assert (got["a.pdf"]["size"], got["a.pdf"]["content_type"]) == (4, "application/pdf")
    assert (got["b.xyz"]["size"], got["b.xyz"]["content_type"]) == (2, None)
    assert len(got["a.pdf"]["etag"]) == 32
    scan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in scan.split("FileScan")[1].split("Batched")[0]


def test_attachments(spark):
    rows = spark.createDataFrame(
        [("A@x", "1.pdf", 10), ("b@x", "2.PDF", 10), ("c@x", "3.doc", 10),
         ("b@x", "4.pdf", 26 * 1024 * 1024)],
        "sender string, filename string, size_bytes long",
    )

    def kept(**rules):
        return {r["filename"][0] for r in files.filter_attachments(rows, **rules).collect()}

    assert kept() == {"1", "2", "3"}
    assert kept(allowed_senders=["a@x"]) == {"1"}
    assert kept(blocked_senders=["a@X"], allowed_types=[".pdf"]) == {"2"}


def test_work_can_be_cleared(spark):
    kept = tables.materialize(spark.range(3), "kept")
    assert kept.count() == 3
    session.clear_work(spark)
    assert not pathlib.Path(session.work_path(spark, "x")).parent.exists()


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.work_path(spark, "x") != session.work_path(spark, "x")
