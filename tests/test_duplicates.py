"""Duplicate detection against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.duplicates import (
    duplicate_matches,
    flag_duplicates,
    mark_duplicates,
)

SCHEMA = """id string, processed_at string, vendor_name string, total_amount double,
  invoice_date string, invoice_number string, is_likely_duplicate boolean,
  anomaly_flags array<string>"""


def random_rows(seed, n, prefix=""):
    pick = random.Random(seed)
    return [
        (
            f"{prefix}{i:04d}",
            f"2024-01-{pick.randint(1, 28):02d}",
            pick.choice(["HOT", "HOT", "b", "c", "", None]),
            pick.choice([1.0, 2.0, None]),
            pick.choice(["2024-01-01", "2024-01-02", "", None]),
            f"n{i}",
            pick.choice([True, False, None]),
            pick.choice([None, [], ["x"], ["potential_duplicate"], ["x", None]]),
        )
        for i in range(n)
    ]


def matches(new, old):
    return (
        bool(new[2])
        and new[2] == old[2]
        and (new[3] is None or new[3] == old[3])
        and (not new[4] or new[4] == old[4])
    )


def earlier_matches(rows, stored=()):
    """Per row, all earlier rows it matches, earliest first."""
    found = {}
    for new in rows:
        old = [(0, o[1], o[0]) for o in stored if matches(new, o)]
        old += [(1, o[1], o[0]) for o in rows if matches(new, o) and (o[1], o[0]) < (new[1], new[0])]
        found[new[0]] = [o[2] for o in sorted(old)]
    return found


@pytest.mark.parametrize("with_stored", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_marks_and_matches_equal_all_pairs(spark, seed, with_stored):
    rows = random_rows(seed, 120)
    stored = random_rows(seed + 10, 60, "s") if with_stored else []
    new = spark.createDataFrame(rows, SCHEMA)
    old = spark.createDataFrame(stored, SCHEMA) if stored else None
    expected = earlier_matches(rows, stored)

    for settle in (False, True):
        marked = mark_duplicates(new, old, settle)
        assert {r["id"]: r["has_earlier_match"] for r in marked.collect()} == {
            k: bool(v) for k, v in expected.items()
        }

    for limit in (1, 5):
        got = {}
        for r in duplicate_matches(new, old, limit).orderBy("id", "match_rank").collect():
            got.setdefault(r["id"], []).append(r["match_id"])
        assert got == {k: v[:limit] for k, v in expected.items() if v}


@pytest.mark.parametrize("settle", [False, True])
def test_flags(spark, settle):
    rows = random_rows(5, 80)
    expected = earlier_matches(rows)
    new = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in flag_duplicates(new, settle=settle).collect()}
    assert len(got) == len(rows)
    for r in rows:
        flagged, flags = r[6], r[7]
        if expected[r[0]] and not flagged:
            flagged = True
            if "potential_duplicate" not in (flags or []):
                flags = [*(flags or []), "potential_duplicate"]
        assert got[r[0]]["is_likely_duplicate"] == flagged
        assert got[r[0]]["anomaly_flags"] == flags


def test_one_key_with_a_third_of_all_rows(spark):
    rows = spark.range(30000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("id"),
        F.lit("2024").alias("processed_at"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("vendor_name"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("total_amount"),
        F.lit("").alias("invoice_date"),
    )
    hits = mark_duplicates(rows).filter("has_earlier_match").count()
    assert hits == 10000 - 1
