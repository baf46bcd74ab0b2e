"""Upsert, partial update, delete and failure records."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import mutations

COLUMNS = """id string, user_id string, processed_at string, notes string, spend_category string,
  tags array<string>"""


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame(rows, columns)


def as_dict(df):
    return {r["id"]: r.asDict() for r in df.collect()}


row = st.tuples(st.sampled_from("abc"), st.just("u"), st.sampled_from(["1", "2", "3", None]),
                st.sampled_from(["x", "y"]), st.none(), st.none())


def newest_first(r):
    return (r[2] is not None, r[2] or "")


def one_per_id(rows):
    return list({r[0]: r for r in rows}.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(row, max_size=8), st.lists(row, min_size=1, max_size=8), st.randoms())
def test_upsert_is_idempotent_and_ignores_row_order(spark, stored, incoming, random):
    stored = one_per_id(stored)
    once = mutations.upsert_latest(table(spark, stored), table(spark, incoming))
    shuffled = list(incoming)
    random.shuffle(shuffled)
    other = mutations.upsert_latest(table(spark, stored[::-1]), table(spark, shuffled), settle=True)
    again = mutations.upsert_latest(once, table(spark, incoming))
    got = as_dict(once)
    assert got == as_dict(other) == as_dict(again)
    assert once.count() == len(got)
    assert set(got) == {r[0] for r in [*stored, *incoming]}
    for id, kept in got.items():
        rows = [r for r in [*stored, *incoming] if r[0] == id]
        best = max(newest_first(r) for r in rows)
        assert newest_first((0, 0, kept["processed_at"])) == best
        sent = [r[3] for r in incoming if r[0] == id and newest_first(r) == best]
        assert kept["notes"] in (sent or [r[3] for r in rows])


def test_upsert_replaces_whole_records(spark):
    stored = table(spark, [("a", "u", "1", "n", "IT", ["t"])])
    reduced = table(spark, [("a", "u", "2", 5)], "id string, user_id string, processed_at string, extra int")
    (got,) = mutations.upsert_latest(stored, reduced).collect()
    assert got.asDict() == {
        "id": "a", "user_id": "u", "processed_at": "2", "notes": None, "spend_category": None,
        "tags": None, "extra": 5,
    }


@pytest.mark.parametrize("settle", [False, True])
def test_upsert_leaves_one_row_of_a_key_stored_twice(spark, settle):
    stored = table(spark, [("1", "u", "2024", "a", None, None), ("1", "u", "2024", "b", None, None),
                           ("2", "u", "2026", "c", None, None), ("2", "u", "2025", "d", None, None),
                           ("3", "u", "1", "e", None, None), ("3", "u", "1", "e", None, None)])
    incoming = table(spark, [("1", "u", "2025", "new", None, None), ("2", "u", "2024", "old", None, None)])
    got = mutations.upsert_latest(stored, incoming, settle=settle).collect()
    assert sorted((r["id"], r["notes"]) for r in got) == [("1", "new"), ("2", "c"), ("3", "e"), ("3", "e")]


def test_upsert_takes_the_incoming_row_at_equal_time(spark):
    stored = table(spark, [("a", "u", "1", "old", None, None), ("b", "u", "5", "kept", None, None)])
    incoming = table(spark, [("a", "u", "1", "new", None, None), ("b", "u", "4", "late", None, None)])
    got = as_dict(mutations.upsert_latest(stored, incoming))
    assert (got["a"]["notes"], got["b"]["notes"]) == ("new", "kept")


STORED = [
    ("a", "u", "1", "n", "IT", ["t"]),
    ("b", "u", "1", "n", "IT", None),
    ("c", "v", "1", "n", "IT", None),
]


@pytest.mark.parametrize("settle", [False, True])
def test_page_edits_ignore_what_is_not_given(spark, settle):
    edits = table(
        spark,
        [("a", "u", None, "HR", ["x", "y"]), ("b", "u", "seen", None, None),
         ("c", "u", "other user", None, None), ("z", "u", "unknown", None, None)],
        "id string, user_id string, notes string, spend_category string, tags array<string>",
    )
    got = as_dict(mutations.apply_page_edits(table(spark, STORED), edits, settle=settle))
    assert (got["a"]["notes"], got["a"]["spend_category"], got["a"]["tags"]) == ("n", "HR", ["x", "y"])
    assert (got["b"]["notes"], got["b"]["spend_category"]) == ("seen", "IT")
    assert got["c"]["notes"] == "n"
    assert set(got) == {"a", "b", "c"}


def test_updates_can_set_null_and_the_last_one_wins(spark):
    changes = table(
        spark,
        [("a", "u", 1, ["notes"], "first", None), ("a", "u", 2, ["notes"], None, None),
         ("a", "u", 1, ["spend_category"], "ignored", "HR"), ("b", "u", 1, [], "ignored", "HR")],
        "id string, user_id string, seq int, fields array<string>, notes string, spend_category string",
    )
    got = as_dict(mutations.apply_updates(table(spark, STORED), changes, sequence="seq"))
    assert (got["a"]["notes"], got["a"]["spend_category"]) == (None, "HR")
    assert (got["b"]["notes"], got["b"]["spend_category"]) == ("n", "IT")


def test_update_guards(spark):
    stored = table(spark, STORED)
    protected = table(spark, [("a", "u", "x")], "id string, user_id string, blob_path string")
    with pytest.raises(ValueError):
        mutations.apply_updates(stored, protected)
    unknown = table(spark, [("a", "u", "x")], "id string, user_id string, colour string")
    with pytest.raises(ValueError):
        mutations.apply_updates(stored, unknown)
    not_editable = table(spark, [("a", "u", "x")], "id string, user_id string, processed_at string")
    with pytest.raises(ValueError):
        mutations.apply_page_edits(stored, not_editable)


@pytest.mark.parametrize("settle", [False, True])
def test_deletes_need_user_and_id(spark, settle):
    keys = table(spark, [("a", "u"), ("a", "u"), ("c", "u")], "id string, user_id string")
    got = mutations.apply_deletes(table(spark, STORED), keys, settle)
    assert set(as_dict(got)) == {"b", "c"}


def test_failure_records_join_the_table(spark):
    messages = table(spark, [("u", "upload", "u/1/a.pdf", "c")],
                     "user_id string, source string, blob_path string, correlation_id string")
    failed = mutations.failure_records(messages, F.lit("f"), F.lit("2024"))
    both = table(spark, STORED).unionByName(failed, allowMissingColumns=True)
    assert as_dict(both)["f"]["status"] == "failed"
    assert as_dict(both)["f"]["notes"] is None
