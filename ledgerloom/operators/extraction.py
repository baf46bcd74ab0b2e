"""Results of the document analysis and of the classification model as invoice columns."""

from pyspark.sql import functions as F

from ledgerloom.functions.normalize import float_text, parse_float, present, text_or
from ledgerloom.schemas import CLASSIFICATION, EXTRACTION, LINE_ITEM, SPEND_CATEGORIES

# What the classification context shows. Its labels below are fixed as well.
CONTEXT_ITEMS = 20
CONTEXT_CHARS = 3000
EXTRACTION_MODEL = "prebuilt-invoice"


def _blank(c):
    return F.coalesce(c, F.lit(""))


def _text(field):
    """`value_string`, else `content`, else empty."""
    return F.when(present(field["value_string"]), field["value_string"]).otherwise(
        _blank(field["content"])
    )


def _date(field):
    return F.when(present(field["value_date"]), field["value_date"]).otherwise(
        _blank(field["content"])
    )


def _amount(field):
    """The typed amount when there is one, else the printed text as a number."""
    return F.when(
        field["value_currency"].isNotNull(), parse_float(field["value_currency"]["amount"])
    ).otherwise(parse_float(field["content"]))


def _line_item(item):
    f = item["value_object"]
    return F.struct(
        _text(f["Description"]).alias("description"),
        parse_float(f["Quantity"]["value_number"]).alias("quantity"),
        _amount(f["UnitPrice"]).alias("unit_price"),
        _amount(f["Amount"]).alias("amount"),
        _text(f["Unit"]).alias("unit"),
        _text(f["ProductCode"]).alias("product_code"),
        _amount(f["Tax"]).alias("tax"),
    )


def extract_fields(df, result="result"):
    """Columns of the first document in a JSON analysis result.

    Results without a document keep their text and page count only. `extraction_failed` marks
    rows whose result is missing or is not JSON.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("_r", F.from_json(result, EXTRACTION, options))
    r = F.col("_r")
    parsed = parsed.withColumn("_d", F.get(r["documents"], F.lit(0)))
    d = F.col("_d")
    f = d["fields"]
    items = F.coalesce(
        F.transform(f["Items"]["value_array"], _line_item),
        F.array().cast(f"array<{LINE_ITEM.simpleString()}>"),
    )
    return parsed.select(
        *[c for c in df.columns if c != result],
        _text(f["VendorName"]).alias("vendor_name"),
        _text(f["VendorAddress"]).alias("vendor_address"),
        _text(f["CustomerName"]).alias("customer_name"),
        _text(f["CustomerAddress"]).alias("customer_address"),
        _text(f["InvoiceId"]).alias("invoice_number"),
        _date(f["InvoiceDate"]).alias("invoice_date"),
        _date(f["DueDate"]).alias("due_date"),
        _text(f["PurchaseOrder"]).alias("purchase_order"),
        _amount(f["InvoiceTotal"]).alias("total_amount"),
        _amount(f["SubTotal"]).alias("subtotal"),
        _amount(f["TotalTax"]).alias("total_tax"),
        text_or(_text(f["CurrencyCode"]), "USD").alias("currency"),
        items.alias("line_items"),
        _blank(r["content"]).alias("raw_text"),
        F.coalesce(F.array_size(r["pages"]), F.lit(0)).alias("page_count"),
        F.coalesce(d["confidence"], F.lit(0.0)).alias("confidence"),
        (F.col(result).isNull() | r["_corrupt"].isNotNull()).alias("extraction_failed"),
    )


def line_items_flat(df):
    """One row per line item, numbered from 1; invoices without items keep one row."""
    return df.select(
        *[c for c in df.columns if c != "line_items"],
        F.posexplode_outer("line_items").alias("_pos", "_item"),
    ).select(
        *[c for c in df.columns if c != "line_items"],
        (F.col("_pos") + 1).alias("item_number"),
        "_item.*",
    )


def classification_context(c_items="line_items"):
    """The text shown to the classifier: header, up to 20 items, the first 3000 characters."""

    def text(name):
        return F.coalesce(F.col(name), F.lit("None"))

    def item(x, i):
        return F.concat(
            F.lit("  "),
            (i + 1).cast("string"),
            F.lit(". "),
            F.coalesce(x["description"], F.lit("None")),
            F.lit(" | qty="),
            float_text(x["quantity"]),
            F.lit(" | unit_price="),
            float_text(x["unit_price"]),
            F.lit(" | amount="),
            float_text(x["amount"]),
        )

    items = F.coalesce(F.col(c_items), F.array().cast(f"array<{LINE_ITEM.simpleString()}>"))
    header = [
        F.concat(F.lit("Vendor: "), text("vendor_name")),
        F.concat(F.lit("Invoice Number: "), text("invoice_number")),
        F.concat(F.lit("Date: "), text("invoice_date")),
        F.concat(F.lit("Due Date: "), text("due_date")),
        F.concat(F.lit("Total: "), float_text("total_amount"), F.lit(" "), text("currency")),
        F.concat(F.lit("Subtotal: "), float_text("subtotal")),
        F.concat(F.lit("Tax: "), float_text("total_tax")),
        F.concat(F.lit("PO: "), text("purchase_order")),
        F.concat(F.lit("Customer: "), text("customer_name")),
        F.concat(F.lit("Line Items ("), F.size(items).cast("string"), F.lit("):")),
    ]
    raw = F.when(
        present("raw_text"),
        F.concat(
            F.lit(f"\n--- Raw Text (first {CONTEXT_CHARS} chars) ---\n"),
            F.substring("raw_text", 1, CONTEXT_CHARS),
        ),
    )
    lines = F.concat(
        F.array(*header), F.transform(F.slice(items, 1, CONTEXT_ITEMS), item), F.array(raw)
    )
    return F.array_join(lines, "\n")


def parse_classification(df, reply="reply"):
    """Columns of a JSON model reply; what is missing takes its default.

    `is_valid` tells whether the reply gave all six fields, a category of the list and a confidence
    from 0 to 1.
    """
    r = F.from_json(reply, CLASSIFICATION)
    parsed = df.withColumn("_c", r)
    c = F.col("_c")
    complete = F.lit(True)
    for name in CLASSIFICATION.names:
        complete = complete & c[name].isNotNull()
    valid = (
        complete
        & c["spend_category"].isin(SPEND_CATEGORIES)
        & c["confidence"].between(0.0, 1.0)
    )
    return parsed.select(
        *[name for name in df.columns if name != reply],
        _blank(c["spend_category"]).alias("spend_category"),
        _blank(c["subcategory"]).alias("subcategory"),
        F.coalesce(c["is_likely_duplicate"], F.lit(False)).alias("is_likely_duplicate"),
        F.coalesce(c["anomaly_flags"], F.array().cast("array<string>")).alias("anomaly_flags"),
        F.coalesce(c["confidence"], F.lit(0.0)).alias("classification_confidence"),
        _blank(c["reasoning"]).alias("classification_reasoning"),
        F.coalesce(valid, F.lit(False)).alias("is_valid"),
    )
