"""Gold tables kept from changes, against tables built anew."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import gold, medallion
from ledgerloom.operators.changes import change_feed
from ledgerloom.plans.incremental_gold import IncrementalGold, gold_between
from ledgerloom.session import work_path
from ledgerloom.sources import runs

SCHEMA = """id string, status string, vendor_name string, invoice_date string, due_date string,
    processed_at string, total_amount double, spend_category string, is_likely_duplicate boolean,
    anomaly_flags array<string>"""


def invoice(rng, i, extreme=False):
    return (
        i, rng.choice(["processed"] * 5 + ["failed"]), rng.choice(["Shop", " shop", "Mill", None]),
        rng.choice(["2024-01-05", "2024-01-20", "2024-02-03", "no date", None]),
        rng.choice(["2024-03-01", None]), "2024-05-01T00:00:00", rng.choice([None, 1e19, 5000.0 if extreme else 9.99])
        if rng.random() < 0.2 else round(rng.uniform(1, 100), 2),
        rng.choice(["IT", "HR", None]), rng.choice([True, False, None]),
        rng.choice([None, [], ["missing_po"], ["a", "b"]]),
    )


def rows_of(df):
    def plain(x):
        return float(f"{x:.9g}") if isinstance(x, float) else x

    return sorted((tuple(sorted((c, str(plain(v))) for c, v in r.asDict().items())) for r in df.collect()))


def assert_same(spark, kept, records):
    silver = medallion.silver(medallion.bronze(spark.createDataFrame(list(records.values()), SCHEMA)))
    for name, build in gold.GOLD_TABLES.items():
        assert rows_of(getattr(kept, name)()) == rows_of(build(silver)), name


@pytest.mark.parametrize("seed", [1])
def test_inserts_updates_and_deletes(spark, seed, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 2)
    rng, records = random.Random(seed), {}
    kept = IncrementalGold(spark, work_path(spark, "gold"))
    for step in range(3):
        changed = {f"i{n}": invoice(rng, f"i{n}", True) for n in rng.sample(range(60), 25 if step else 50)}
        deleted = [] if step == 0 else rng.sample(sorted(records), 8)
        for i in deleted:
            changed.pop(i, None)
        records |= changed
        for i in deleted:
            records.pop(i)
        gone = spark.createDataFrame([(i,) for i in [*deleted, "never there"]], "id string")
        kept.apply(spark.createDataFrame(list(changed.values()), SCHEMA), gone if step else None)
        if step == 1:
            assert_same(spark, kept, records)
    assert_same(spark, IncrementalGold(spark, kept.path), records)


def test_the_least_and_the_largest_go(spark):
    base = {f"i{n}": (f"i{n}", "processed", "Shop", "2024-01-05", None, "2024-05-01T00:00:00", float(n), "IT", False, None)
            for n in range(1, 9)}
    kept = IncrementalGold(spark, work_path(spark, "gold"))
    kept.apply(spark.createDataFrame(list(base.values()), SCHEMA))
    for gone in ("i8", "i1"):
        base.pop(gone)
        kept.apply(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(gone,)], "id string"))
    assert_same(spark, kept, base)
    base["i5"] = (*base["i5"][:6], 0.5, *base["i5"][7:])
    kept.apply(spark.createDataFrame([base["i5"]], SCHEMA))
    assert_same(spark, kept, base)
    everything = spark.createDataFrame([(i,) for i in base], "id string")
    kept.apply(spark.createDataFrame([], SCHEMA), everything)
    assert kept.spend_by_category().count() == kept.vendor_analysis().count() == 0


def test_a_batch_given_again_counts_once(spark):
    rng = random.Random(3)
    records = {f"i{n}": invoice(rng, f"i{n}") for n in range(20)}
    kept = IncrementalGold(spark, work_path(spark, "gold"))
    kept.apply(spark.createDataFrame(list(records.values())[:10], SCHEMA), None, "stream", 0)
    for _ in range(2):
        kept.apply(spark.createDataFrame(list(records.values())[5:], SCHEMA), None, "stream", 1)
    assert_same(spark, kept, records)


def test_a_batch_reads_the_records_of_its_ids_only(spark, monkeypatch):
    """Records are read whole only where a least or largest value has gone."""
    records = {f"i{n:05d}": (f"i{n:05d}", "processed", f"V{n % 50}", "2024-01-05", None, "2024-05-01T00:00:00",
                             10.0 + n, "IT", False, None) for n in range(3000)}
    kept = IncrementalGold(spark, work_path(spark, "gold"))
    kept.apply(spark.createDataFrame(list(records.values()), SCHEMA))
    whole = []
    read_all = runs.RunTable.rows
    monkeypatch.setattr(runs.RunTable, "rows", lambda self, *a: (whole.append(self.path), read_all(self, *a))[1])
    middle = records["i01500"]
    kept.apply(spark.createDataFrame([(*middle[:6], 1511.0, *middle[7:])], SCHEMA))
    assert whole == []
    kept.apply(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("i02999",)], "id string"))
    assert [p.split("/")[-1] for p in whole] == ["records"] * len(whole) and whole


def test_change_feed(spark):
    schema = "id string, a int, tags array<string>"
    old = spark.createDataFrame([("1", 1, ["x"]), ("2", 2, None), ("3", None, []), (None, 5, None)], schema)
    new = spark.createDataFrame([("1", 1, ["x"]), ("2", 3, None), ("4", 4, ["y"]), (None, 6, None)], schema)
    for settle in (False, True):
        got = {r.id: (r.a, r._change) for r in change_feed(old, new.select("tags", "a", "id"), settle=settle).collect()}
        assert got == {"2": (3, "update"), "3": (None, "delete"), "4": (4, "insert")}
    assert change_feed(old, old).count() == 0
    assert {r._change for r in change_feed(old.limit(0), new).collect()} == {"insert"}


def test_from_one_version_to_the_next(spark):
    rng = random.Random(9)
    first = {f"i{n}": invoice(rng, f"i{n}") for n in range(30)}
    second = {**{i: r for i, r in first.items() if rng.random() < 0.8}, "new": invoice(rng, "new")}
    second["i3"] = invoice(rng, "i3")
    frames = [spark.createDataFrame(list(v.values()), SCHEMA) for v in (first, second)]
    kept = IncrementalGold(spark, work_path(spark, "gold"))
    kept.apply(frames[0])
    gold_between(*frames, kept)
    assert_same(spark, kept, second)
    assert kept.monthly_trend().filter(F.col("unique_vendors") > 2).count() == 0


def test_versions_read_the_input_once(spark, monkeypatch):
    """The first version is made of the second as it is stored, not of the given tables again."""
    from ledgerloom.plans import registry
    from ledgerloom.schemas import INVOICE

    rows = [{"id": str(k), "processed_at": "1", "total_amount": float(k), "spend_category": "IT"} for k in range(1, 30)]
    given = spark.createDataFrame(rows, INVOICE).select(registry.SILVER_INPUT)
    monkeypatch.setattr(registry, "invoices", lambda *a: given)
    written, write = {}, registry.tables.materialize

    def materialize(df, name):
        written[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(registry.tables, "materialize", materialize)
    old, new = registry._versions(spark, "unused")
    assert "LogicalRDD" in written["v2"] and "LogicalRDD" not in written["v1"]
    assert new.count() == 29
    assert {r["id"]: r["total_amount"] for r in old.collect()}["6"] == 68.0
    assert {"gone-2", "gone-13", "gone-24"} <= {r["id"] for r in old.collect()}
