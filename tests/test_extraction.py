"""Analysis results, model replies, rules and the scorer stage."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classification, extraction
from ledgerloom.schemas import INVOICE


def extract(spark, *results):
    texts = [r if r is None or isinstance(r, str) else json.dumps(r) for r in results]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, result string")
    return sorted(extraction.extract_fields(rows).collect(), key=lambda r: r["i"])


def test_fields_prefer_typed_values(spark):
    fields = {
        "VendorName": {"value_string": "Acme", "content": "ACME Inc"},
        "CustomerName": {"value_string": "", "content": "Bob"},
        "VendorAddress": {"content": None},
        "InvoiceId": {"value_string": None, "content": "I-1"},
        "InvoiceDate": {"value_date": "2024-01-02", "content": "Jan 2"},
        "DueDate": {"content": "Feb 1"},
        "InvoiceTotal": {"value_currency": {"amount": 12.5}, "content": "13"},
        "SubTotal": {"content": "10.25"},
        "TotalTax": {"content": "1,234.56"},
        "Items": {
            "value_array": [
                {
                    "value_object": {
                        "Description": {"content": "Pen"},
                        "Quantity": {"value_number": 3, "content": "4"},
                        "UnitPrice": {"value_currency": {"amount": 1.5}},
                        "Amount": {"content": "4.5"},
                        "Tax": {"value_currency": {"amount": None}, "content": "9"},
                    }
                },
                {"value_object": None},
                {"value_object": {"Quantity": {"content": "4"}}},
            ]
        },
    }
    (got,) = extract(
        spark,
        {
            "content": "text",
            "pages": [{}, {}],
            "documents": [{"confidence": 0.5, "fields": fields}, {"confidence": 0.9, "fields": {}}],
        },
    )
    assert (got["vendor_name"], got["customer_name"], got["vendor_address"]) == ("Acme", "Bob", "")
    assert (got["invoice_number"], got["purchase_order"]) == ("I-1", "")
    assert (got["invoice_date"], got["due_date"]) == ("2024-01-02", "Feb 1")
    assert (got["total_amount"], got["subtotal"], got["total_tax"]) == (12.5, 10.25, None)
    assert (got["currency"], got["page_count"], got["confidence"]) == ("USD", 2, 0.5)
    pen, empty, content_only = got["line_items"]
    assert (pen["description"], pen["quantity"], pen["unit_price"], pen["amount"]) == (
        "Pen", 3.0, 1.5, 4.5,
    )
    assert (pen["tax"], pen["unit"]) == (None, "")
    assert (empty["description"], empty["amount"]) == ("", None)
    # A quantity is read from the number only, never from the printed text.
    assert content_only["quantity"] is None
    assert got["extraction_failed"] is False


def test_results_without_document_and_broken_results(spark):
    plain, missing, broken, empty = extract(
        spark, {"content": "only text", "pages": [{}], "documents": []}, None, "{not json", {}
    )
    assert (plain["raw_text"], plain["page_count"], plain["currency"]) == ("only text", 1, "USD")
    assert (plain["vendor_name"], plain["line_items"], plain["confidence"]) == ("", [], 0.0)
    assert [r["extraction_failed"] for r in (plain, missing, broken, empty)] == [
        False, True, True, False,
    ]


def test_replies(spark):
    full = {
        "spend_category": "IT", "subcategory": "s", "is_likely_duplicate": True,
        "anomaly_flags": ["a"], "confidence": 1.0, "reasoning": "r",
    }
    replies = [
        json.dumps(full),
        json.dumps({**full, "spend_category": "Gardening"}),
        json.dumps({**full, "confidence": 1.5}),
        json.dumps({"spend_category": "HR"}),
        None,
        "{}",
        "not json",
    ]
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = sorted(extraction.parse_classification(rows).collect(), key=lambda r: r["i"])
    assert [r["is_valid"] for r in got] == [True, False, False, False, False, False, False]
    assert [r["spend_category"] for r in got[:4]] == ["IT", "Gardening", "IT", "HR"]
    defaults = ("", "", False, [], 0.0, "", False)
    assert [tuple(r)[1:] for r in got[4:]] == [defaults] * 3


def test_line_items_to_rows(spark):
    items = "array(named_struct('description', 'a', 'amount', 1d), named_struct('description', 'b', 'amount', 2d))"
    rows = spark.sql(
        f"select '1' id, {items} line_items union all select '2', array() "
        "union all select '3', null"
    )
    got = extraction.line_items_flat(rows).orderBy("id", "item_number").collect()
    assert [(r["id"], r["item_number"], r["description"]) for r in got] == [
        ("1", 1, "a"), ("1", 2, "b"), ("2", None, None), ("3", None, None),
    ]


def invoice(spark, **values):
    return spark.createDataFrame([tuple(values.get(c) for c in INVOICE.names)], INVOICE)


def test_context(spark):
    item = ("Pen", 3.0, 12345678.5, None, "", "", None)
    rows = invoice(
        spark, vendor_name="Acme", invoice_number="1", invoice_date="", due_date="d",
        total_amount=None, currency="USD", subtotal=1e16, total_tax=0.5, purchase_order="",
        customer_name="c", line_items=[item] * 25, raw_text="x" * 5000,
    )
    lines = rows.select(extraction.classification_context()).first()[0].split("\n")
    assert lines[:10] == [
        "Vendor: Acme", "Invoice Number: 1", "Date: ", "Due Date: d", "Total: None USD",
        "Subtotal: 1e+16", "Tax: 0.5", "PO: ", "Customer: c", "Line Items (25):",
    ]
    assert lines[10] == "  1. Pen | qty=3.0 | unit_price=12345678.5 | amount=None"
    assert lines[29].startswith("  20. ")
    assert lines[30:] == ["", "--- Raw Text (first 3000 chars) ---", "x" * 3000]
    bare = invoice(spark, vendor_name="Acme")
    assert bare.select(extraction.classification_context()).first()[0].endswith("Line Items (0):")


def test_keyword_rules(spark):
    vendors = ["Contoso Software", "City Water", "water and software", "", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vendors)], "i int, vendor_name string")
    rows = rows.withColumn("line_items", F.array(F.struct(F.lit("x").alias("description"))))
    got = sorted(classification.classify_with_rules(rows).collect(), key=lambda r: r["i"])
    assert [r["rule_category"] for r in got] == ["IT", "Utilities", "IT", "Other", "Other"]
    own = classification.classify_with_rules(rows, [("city", "HR", 1), ("city", "Legal", 1)])
    assert own.filter("i = 1").first()["rule_category"] == "HR"


def test_own_scorer(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 200.0)], "id string, total_amount double")

    def scorer(frames):
        for frame in frames:
            frame["spend_category"] = ["IT" if x > 100 else "Other" for x in frame.total_amount]
            yield frame[["id", "spend_category"]]

    got = classification.classify_with(rows, scorer, "id string, spend_category string").collect()
    assert {r["id"]: r["spend_category"] for r in got} == {"a": "Other", "b": "IT"}


@pytest.mark.parametrize("settle", [False, True])
def test_anomaly_rules(spark, settle):
    rows = spark.createDataFrame(
        [("1", "v", 300.0, "", "2024-01-06"), ("2", "v", 10.5, "p", "2024-01-08"),
         ("3", "v", 1.0, "p", "x"), ("4", "v", 1.0, None, ""), ("5", None, None, "p", None),
         ("6", "w", 0.0, "p", "2024-01-07")],
        "id string, vendor_name string, total_amount double, purchase_order string, invoice_date string",
    )
    got = {r["id"]: r["rule_flags"] for r in classification.anomaly_rules(rows, settle).collect()}
    assert got == {
        "1": ["unusually_high_amount", "round_number", "weekend_date", "missing_po"],
        "2": [], "3": [], "4": ["missing_po"], "5": [], "6": ["weekend_date"],
    }
