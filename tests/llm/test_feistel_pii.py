import datetime
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import pii
from ledgerloom.llm.feistel import ArrayPermutation, Permutation
from ledgerloom.llm import queries
from ledgerloom.llm.queries import QUERIES
from tests.conftest import DATA

KEY = b"a key"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutations_are_one_to_one(n):
    p, q = Permutation(n, KEY), ArrayPermutation(n, "a key")
    images = [p(x) for x in range(n)]
    assert sorted(images) == list(range(n))
    assert [p.inverse(y) for y in images] == list(range(n))
    moved = [p.pseudonym(x) for x in range(n)]
    assert sorted(moved) == list(range(n)) and [p.original(y) for y in moved] == list(range(n))
    assert n == 1 or all(x != y for x, y in enumerate(moved))
    x = np.arange(n)
    assert sorted(q(x).tolist()) == list(range(n)) and (q.inverse(q(x)) == x).all()


@given(st.integers(1, 10**40), st.data())
def test_large_permutations_turn_back(n, data):
    x = data.draw(st.integers(0, n - 1))
    p = Permutation(n, KEY)
    assert 0 <= p(x) < n and p.inverse(p(x)) == x and p.original(p.pseudonym(x)) == x


VALID = {
    "email": ["jane.doe@example.com", "a@b.org", "X_9%y+z@mail-8.example.co.uk"],
    "card": ["4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795"],
    "phone": ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+44 20 7946 0958", "+49 30 123456"],
    "ip": ["42.144.35.254", "0.0.0.0", "255.255.255.255"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606"],
    "date": ["2024-02-29", "29.02.2024", "02/29/2024", "1900-01-01", "2099/12/31"],
}


@pytest.mark.parametrize("kind", VALID)
def test_values_move_within_their_format_and_back(kind):
    for value in VALID[kind]:
        for text in (value, f"see {value}, or ({value}).", f"{value}\n{value}"):
            moved, found = pii.replace_values(text, KEY)
            assert found == {kind: text.count(value)}, (value, text, moved)
            assert value not in moved
            assert len(moved) == len(text) or kind == "ip"
            again, found_again = pii.replace_values(moved, KEY, back=True)
            assert again == text and found_again == found
            other, _ = pii.replace_values(text, b"another key")
            assert other != moved


def test_equal_values_stay_linked_in_every_layout():
    digits = lambda t: "".join(c for c in t if c.isdigit())
    move = lambda t: pii.replace_values(t, KEY)[0]
    assert len({digits(move(c)) for c in VALID["card"]}) == 1
    assert len({digits(move(p))[-10:] for p in VALID["phone"][:3]}) == 1
    days = [move("2024-02-29"), move("29.02.2024"), move("02/29/2024")]
    parsed = {
        datetime.datetime.strptime(d, f) for d, f in zip(days, ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"])
    }
    assert len(parsed) == 1
    assert move("Jane@Example.com").lower() == move("jane@example.com").lower()


def test_pseudonyms_of_different_cards_differ():
    rng, seen = random.Random(1), {}
    for _ in range(2000):
        head = "404189" + "".join(rng.choice("0123456789") for _ in range(9))
        card = head + pii._luhn(head)
        new = pii.replace_values(card, KEY)[0]
        assert pii._luhn(new[:-1]) == new[-1]
        assert seen.setdefault(new, card) == card


@pytest.mark.parametrize(
    "text",
    [
        "4041894974608796", "256.1.1.1", "1.2.3", "1.2.3.4.5", "000-12-3456", "666-12-3456", "900-12-3456",
        "2023-02-29", "31.04.2020", "DE89370400440532013001", "1234567", "version 2.10.3", "12:30:45",
        "price 1,234.50", "order 20240229 of 7", "call 123-456-7890", "a@b", "@home", "3 @ 4.50", "0.5-0.75",
        "", "no numbers at all", "1899-12-31",
    ],
)
def test_what_is_no_valid_value_stays(text):
    assert pii.replace_values(text, KEY) == (text, {})


def test_values_far_apart_in_a_long_text():
    filler = "lorem ipsum " * 5000
    text = f"{filler}4041894974608795 {filler}jane.doe@example.com{filler}2024-02-29."
    moved, found = pii.replace_values(text, KEY)
    assert found == {"card": 1, "email": 1, "date": 1}
    assert moved.count(filler) == 3


def test_documents_keep_their_columns_and_clean_texts(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    new = pii.pseudonymise(docs, "k", counts_col="counts")
    assert new.columns == [*docs.columns, "counts"]
    old = {r.doc_id: r.text for r in docs.collect()}
    changed = 0
    for r in new.collect():
        expected, found = pii.replace_values(old[r.doc_id], b"k")
        assert (r.text, r.counts) == (expected, dict(found))
        changed += bool(found)
    assert 0 < changed < len(old) / 2
    back = pii.pseudonymise(new.drop("counts"), "k", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == old
    same = pii.pseudonymise(odd, "k")
    key = lambda r: (r.row,)
    assert sorted(same.collect(), key=key) == sorted(odd.collect(), key=key)
    assert pii.pseudonymise(empty, "k").count() == 0


def test_columns_with_dots_and_clashing_names(spark):
    rows = [("x", "mail jane@example.com", {"a": 1})]
    docs = spark.createDataFrame(rows, "`a.b` string, text string, counts map<string,int>")
    r = pii.pseudonymise(docs, "k", counts_col="n").first()
    assert r["a.b"] == "x" and r["counts"] == {"a": 1} and r["n"] == {"email": 1}


def test_query_changes_no_clean_text(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.text == docs[r.doc_id]) == (r.n_replaced == 0) == (r.kinds == "")


def test_a_key_is_needed(odd):
    with pytest.raises(ValueError):
        pii.pseudonymise(odd, "")


OFF_PLAN = ["+1 (132) 555-1352", "+1 (017) 555-7713", "+1 988 055 2485", "(132) 555-1352", "(988) 155-2485"]
OTHER_ORDER = ["25/12/2020", "31/01/1999", "12-25-2020", "12.31.2099"]


@pytest.mark.parametrize("value", OFF_PLAN + OTHER_ORDER + ["2024-02-29T10:00:00Z", "29.02.2024T10:00"])
def test_values_off_the_plan_or_in_the_other_order_move_too(value):
    for text in (value, f"see {value}, or ({value})."):
        moved, found = pii.replace_values(text, KEY)
        kind = "phone" if value in OFF_PLAN else "date"
        assert found == {kind: text.count(value)}
        assert value not in moved and len(moved) == len(text)
        assert pii.replace_values(moved, KEY, back=True) == (text, found)


def test_off_plan_numbers_stay_linked_and_apart():
    digits = lambda t: "".join(c for c in t if c.isdigit())[-10:]
    move = lambda t: digits(pii.replace_values(t, KEY)[0])
    assert move("+1 (132) 555-1352") == move("(132) 555-1352") == move("+11325551352")
    rng, seen = random.Random(3), {}
    for _ in range(2000):
        local = rng.choice("01") + "".join(rng.choice("0123456789") for _ in range(9))
        new = move(f"+1{local}")
        assert (new[0] in "01" or new[3] in "01") and seen.setdefault(new, local) == local


def test_no_phone_of_the_given_table_stays():
    import re

    import pyarrow.parquet as pq

    shape, found = re.compile(r"(?<![\w.+])\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![\w-])"), 0
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist():
        phones = [(m.start(), m[0]) for m in shape.finditer(text or "")]
        if phones:
            moved = pii.replace_values(text, KEY)[0]
            found += len(phones)
            assert not [p for _, p in phones if p in moved]
    assert found > 100


def test_every_date_is_linked_in_all_layouts():
    """All days that the permutation covers: equal dates stay equal in whatever layout they are written
    and read, different ones differ, and the key undoes it."""
    key = b"a key"
    layouts = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d-%m-%Y", "%m/%d/%Y"]
    seen = set()
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    for number in range(first, last + 1):
        day = datetime.date.fromordinal(number)
        late = day.day > 12
        forms = layouts + ["%d/%m/%Y", "%m.%d.%Y", "%m-%d-%Y"] * late
        moved = set()
        for form in forms if number % 7 == 0 or number < first + 800 else forms[::5] + forms[5:6]:
            new, found = pii.replace_values(day.strftime(form), key)
            assert found == {"date": 1}
            moved.add(datetime.datetime.strptime(new, form).date())
            if number % 11 == 0:
                assert pii.replace_values(new, key, back=True)[0] == day.strftime(form)
        (new,) = moved
        assert new != day and (new.day > 12) == late
        seen.add(new)
    assert len(seen) == last - first + 1


def test_clashing_temporary_names(spark):
    docs = spark.createDataFrame([(1, "a@b.de", "x", "y")], "doc_id int, text string, _replaced string, _REPLACED_ string")
    (row,) = pii.pseudonymise(docs, "k").collect()
    assert row["_replaced"] == "x" and row["_REPLACED_"] == "y" and row["text"] != "a@b.de"


def test_query_equals_the_plain_function(spark):
    """The query, row by row, against `replace_values` alone; what it leaves, no pattern finds valid."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    key = queries.KEY.encode()
    for r in rows:
        new, found = pii.replace_values(docs[r.doc_id] or "", key)
        assert (r.text or "") == new and r.n_replaced == sum(found.values())
        assert r.kinds == ",".join(sorted(found))
        assert pii.replace_values(new, key, back=True)[0] == (docs[r.doc_id] or "")
