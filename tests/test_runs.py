"""Tables of sorted runs."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.session import work_path
from ledgerloom.sources import runs
from ledgerloom.sources.runs import RunTable
from tests.conftest import scanned_rows


def keys(spark, first, n):
    return spark.range(first, first + n).select(F.xxhash64("id").alias("h"), F.col("id").alias("k"))


@pytest.fixture
def table(spark):
    def add_up(rows):
        return rows.distinct()

    return RunTable(spark, work_path(spark, "runs"), "h long, k long", "h", add_up)


def test_every_key_is_found_and_no_other(spark, table):
    assert table.rows().collect() == [] and table.find(keys(spark, 0, 3)).collect() == []
    for n in range(20):
        table.put(keys(spark, n * 100, 100), "w", n)
        asked = keys(spark, n * 50, 60)
        got = sorted(r["k"] for r in table.find(asked).collect())
        assert got == [k for k in range(n * 50, n * 50 + 60) if k < (n + 1) * 100]
    assert sorted(r["k"] for r in table.rows().collect()) == list(range(2000))


def test_runs_stay_few_and_rows_are_combined(spark, table):
    for n in range(30):
        table.put(keys(spark, 0, 50), "w", n)
    levels = [r["level"] for r in table.runs()]
    assert max(levels.count(level) for level in set(levels)) <= runs.FAN and max(levels) >= 1
    assert sum(r["rows"] for r in table.runs()) < 30 * 50
    # Old runs and manifests have gone.
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/runs")
    kept = {s.getPath().getName() for s in table.manifests.files.listStatus(folder)}
    assert len(kept) < 30 and {r["folder"].split("/")[1] for r in table.runs()} <= kept
    assert len(table.manifests.numbers()) <= runs.KEPT_MANIFESTS


def test_a_repeated_batch_replaces_itself_and_does_not_see_itself(spark, table):
    for n in range(12):
        table.put(keys(spark, n * 10, 10), "w", n)
    table.put(keys(spark, 0, 10), "other", 0)
    for _ in range(2):
        table.put(keys(spark, 110, 5), "w", 11)
    assert sorted(r["k"] for r in table.rows().distinct().collect()) == list(range(115))
    seen = table.find(keys(spark, 105, 10), ("w", 11)).collect()
    assert sorted(r["k"] for r in seen) == list(range(105, 110))


def test_rows_read_stay_flat_while_the_table_grows(spark, table):
    read = {}
    table.put(keys(spark, 0, 50_000), "w", 0)
    table.put(keys(spark, -10, 5), "w", 1)
    asked = keys(spark, 17, 5)
    read[1] = scanned_rows(table.find(asked))
    table.put(keys(spark, 50_000, 1_000_000), "w", 2)
    table.put(keys(spark, -20, 5), "w", 3)
    read[20] = scanned_rows(table.find(asked))
    assert table.find(asked).count() == 5
    assert read[1] <= 5 * runs.PAGE_ROWS + 10 and read[20] <= 2 * 5 * runs.PAGE_ROWS + 10


def test_keys_of_several_scans(spark, table, monkeypatch):
    monkeypatch.setattr(runs, "PAGE_ROWS", 1)
    for n in range(3):
        table.put(keys(spark, n * 3000, 3000), "w", n)
    got = sorted(r["k"] for r in table.find(keys(spark, 1000, 6000)).collect())
    assert got == list(range(1000, 7000))


def test_many_keys_are_joined(spark, table, monkeypatch):
    monkeypatch.setattr(runs, "MAX_ASKED", 20)
    table.put(keys(spark, 0, 100), "w", 0)
    assert sorted(r["k"] for r in table.find(keys(spark, 30, 40)).collect()) == list(range(30, 70))
    assert table.find(keys(spark, 30, 5)).count() == 5


def test_two_writers_lose_nothing(spark, table, monkeypatch):
    """Another writer adds a run between this one's reading of the manifest and its writing."""
    first = runs.Manifests.numbers
    other = RunTable(spark, table.path, "h long, k long", "h")
    state = {"calls": 0}

    def numbers(self):
        found = first(self)
        if self is table.manifests:
            state["calls"] += 1
            if state["calls"] == 1:
                monkeypatch.setattr(runs.Manifests, "numbers", first)
                other.put(keys(spark, 100, 10), "b", 0)
                monkeypatch.setattr(runs.Manifests, "numbers", numbers)
        return found

    monkeypatch.setattr(runs.Manifests, "numbers", numbers)
    table.put(keys(spark, 0, 10), "a", 0)
    monkeypatch.setattr(runs.Manifests, "numbers", first)
    assert sorted(r["k"] for r in table.rows().collect()) == [*range(10), *range(100, 110)]


def test_a_reader_keeps_its_state_during_a_write(spark, table):
    table.put(keys(spark, 0, 10), "w", 0)
    before = table.rows()
    for n in range(1, 6):
        table.put(keys(spark, n * 10, 10), "w", n)
    assert before.count() == 10 and table.rows().count() == 60


def test_manifest_names_ranges(spark, table):
    table.put(keys(spark, 0, 10), "w", 0)
    (run,) = table.runs()
    hashes = [r["h"] for r in keys(spark, 0, 10).collect()]
    assert min(f["low"] for f in run["files"]) == min(hashes)
    assert max(f["high"] for f in run["files"]) == max(hashes)
    assert run["rows"] == 10 and json.dumps(run)
