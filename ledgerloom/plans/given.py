"""Invoice records and other inputs derived from the given tables.

Every rule is integer arithmetic on the order key `k`, and `oracle.py` states the same rules in SQL.
Only the tables the wanted columns need are joined.
"""

from pyspark.sql import functions as F

from ledgerloom.functions.intake import CREATED_EVENT, subject_prefix
from ledgerloom.functions.money import money_sum
from ledgerloom.schemas import INVOICE, SPEND_CATEGORIES

CONTAINER = "uploads"

# Words the line items are described with, one per spend category, in the categories' order.
ITEM_WORDS = [
    "laptop",
    "advertising",
    "cleaning",
    "flight",
    "recruiting",
    "contract review",
    "advisory",
    "paper",
    "electricity",
    "sundry",
]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows, key):
    """The rows over as many tasks as there are cores, where their files give fewer. The records derived
    from them take far more time than the small files they come from."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, key)


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _line_items(k, total):
    """Up to five items (25 for every 30th order) that split the order's price exactly."""
    n = F.when(k % 30 == 0, 25).otherwise(k % 6).cast("int")
    parts = F.greatest(n, F.lit(1)).cast("bigint")

    def item(i, cents):
        quantity = 1 + (k + i) % 9
        amount = F.floor(cents * i / parts) - F.floor(cents * (i - 1) / parts)
        word = _pick(ITEM_WORDS, (k + i) % 10)
        described = F.when((k + i) % 17 == 0, F.lit("")).otherwise(
            F.concat_ws(" ", word, i.cast("string"))
        )
        return F.struct(
            described.alias("description"),
            quantity.cast("double").alias("quantity"),
            (F.floor(amount / quantity) / 100.0).alias("unit_price"),
            (amount / 100.0).alias("amount"),
            F.when(i % 2 == 0, "ea").otherwise("").alias("unit"),
            F.concat(F.lit("P-"), ((k + i) % 100).cast("string")).alias("product_code"),
            F.when(i % 3 != 0, F.floor(amount * 8 / 100) / 100.0).alias("tax"),
        )

    def items(cents):
        return F.transform(F.sequence(F.lit(1).cast("bigint"), parts), lambda i: item(i, cents))

    # The cents are rounded once for an order, not for each of its items.
    cents = F.array(F.round(total * 100).cast("bigint"))
    return F.slice(F.get(F.transform(cents, items), F.lit(0)), F.lit(1), n)


def invoices(spark, sf_dir, *columns, copies=True, files=None):
    """The invoice records with the given columns, all of them when none is given.

    Some records have an exact copy, some a near copy stored the next day, unless `copies` is off.
    `files` holds order keys, `o_orderkey`, and further columns that are given as well: only these
    orders' records, found before any other table is joined.
    """
    wanted = list(columns) or INVOICE.names
    k = F.col("o_orderkey")
    rows = _spread(table(spark, sf_dir, "orders"), "o_orderkey")
    carried = []
    if files is not None:
        rows, carried = rows.join(files, "o_orderkey"), [c for c in files.columns if c != "o_orderkey"]

    # The join by another key comes first, while the rows are narrow; all others go by the order's key.
    if "customer_name" in wanted:
        customer = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_name"
        )
        rows = rows.join(customer, "o_custkey", "left")
    if {"vendor_name", "subtotal", "total_tax"} & set(wanted):
        lines = table(spark, sf_dir, "lineitem")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        tax = cents * F.round(F.col("l_tax") * 100).cast("bigint")
        per_order = (
            lines.groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(
                F.min("l_suppkey").alias("s_suppkey"),
                money_sum("l_extendedprice").alias("subtotal"),
                (F.sum(tax) / 10000).alias("total_tax"),
            )
        )
        rows = rows.join(per_order, "o_orderkey", "left")
    if "vendor_name" in wanted:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        rows = rows.join(supplier, "s_suppkey", "left")
    if "raw_text" in wanted:
        texts = table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("o_orderkey"), F.col("text").alias("raw_text")
        )
        rows = rows.join(texts, "o_orderkey", "left")

    # 0 is the record itself, 1 an exact copy, 2 a near copy.
    which = F.array(F.lit(0), F.when(k % 150 == 0, F.lit(1)), F.when(k % 40 == 7, F.lit(2)))
    rows = rows.withColumn("_copy", F.explode(F.array_compact(which)) if copies else F.lit(0))

    day = F.col("o_orderdate").cast("date")
    key = k.cast("string")
    user = F.concat(F.lit("user"), (F.col("o_custkey") % 20).cast("string"))
    near = F.col("_copy") == 2
    s_name = F.col("s_name")
    rules = {
        "id": lambda: F.when(near, F.concat(key, F.lit("-d"))).otherwise(key),
        "user_id": lambda: user,
        "source": lambda: F.when(k % 4 == 0, "email").otherwise("upload"),
        "blob_path": lambda: F.when(
            k % 4 == 0, F.concat(F.lit("email/m"), key, F.lit("/inv.pdf"))
        ).otherwise(F.concat(user, F.lit("/u"), key, F.lit("/inv.pdf"))),
        "status": lambda: F.when(
            (F.col("o_orderstatus") == "P") & (k % 3 == 0), "failed"
        ).otherwise("processed"),
        "vendor_name": lambda: F.when(
            k % 3 == 1, F.concat(F.lit("  "), F.lower(s_name), F.lit(" "))
        )
        .when(k % 3 == 2, F.upper(s_name))
        .otherwise(s_name),
        "vendor_address": lambda: F.lit(""),
        "customer_name": lambda: F.col("c_name"),
        "invoice_number": lambda: F.concat(F.lit("INV-"), key),
        "invoice_date": lambda: F.when(k % 50 == 7, "")
        .when(k % 50 == 8, "Jan 5")
        .otherwise(day.cast("string")),
        "due_date": lambda: F.when(k % 30 == 3, "").otherwise(
            F.date_add(day, (k % 75).cast("int")).cast("string")
        ),
        "purchase_order": lambda: F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("PO-"), key)),
        "total_amount": lambda: F.when(k % 97 == 0, None)
        .when(k % 40 == 0, F.col("o_totalprice") * 10)
        .otherwise(F.col("o_totalprice")),
        "subtotal": lambda: F.col("subtotal"),
        "total_tax": lambda: F.col("total_tax"),
        "currency": lambda: _pick([None, "usd", " eur ", "GBP", "xyz", ""], k % 6),
        "spend_category": lambda: F.when(k % 101 == 0, None).otherwise(
            _pick(SPEND_CATEGORIES, k % 10)
        ),
        "subcategory": lambda: F.concat(F.lit("sub"), (k % 3).cast("string")),
        "is_likely_duplicate": lambda: F.when(k % 20 == 0, True)
        .when(k % 20 == 1, None)
        .otherwise(False),
        "anomaly_flags": lambda: F.when(k % 11 == 0, None)
        .when(k % 8 == 0, F.array(F.lit("round_number"), F.lit("missing_po")))
        .when(k % 4 == 0, F.array(F.lit("round_number")))
        .otherwise(F.array().cast("array<string>")),
        "classification_confidence": lambda: (k % 100) / 100,
        "classification_reasoning": lambda: F.concat(
            F.lit("because "), (k % 10).cast("string")
        ),
        "page_count": lambda: (1 + k % 5).cast("int"),
        "processed_at": lambda: F.when(
            near, F.concat(F.date_add(day, 1).cast("string"), F.lit("T00:00:00+00:00"))
        ).otherwise(
            F.concat(
                day.cast("string"),
                F.lit("T"),
                F.lpad((k % 24).cast("string"), 2, "0"),
                F.lit(":00:00+00:00"),
            )
        ),
        "correlation_id": lambda: F.concat(F.lit("c"), key),
        "line_items": lambda: _line_items(k, F.col("o_totalprice")),
        "extraction_model": lambda: F.lit("prebuilt-invoice"),
        "classification_model": lambda: F.lit(""),
        "raw_text": lambda: F.col("raw_text"),
        "tags": lambda: F.array().cast("array<string>"),
        "notes": lambda: F.lit(""),
    }
    return rows.select(*[rules[c]().alias(c) for c in wanted], *carried)


def file_events(spark, sf_dir):
    """File events from the `events` table, in the shape of storage notifications."""
    e = F.col("event_id")
    name = (
        F.when(e % 8 == 0, "file.pdf")
        .when(e % 8 == 1, "file.PDF")
        .when(e % 8 == 2, "file.png")
        .when(e % 8 == 3, "file.tiff")
        .when(e % 8 == 4, "file.docx")
        .when(e % 8 == 5, "file")
        .otherwise("file.pdf")
    )
    folder = (
        F.when(e % 8 == 6, F.lit(""))
        .when(e % 8 == 7, F.concat(F.lit("email/e"), e.cast("string"), F.lit("/")))
        .otherwise(
            F.concat(
                F.lit("user"), F.col("user_id").cast("string"),
                F.lit("/e"), e.cast("string"), F.lit("/"),
            )
        )
    )
    # Paths of two parts only: the file lies directly in the user's folder.
    short = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("-"), e.cast("string"))
    path = F.when(e % 8 == 6, F.concat(short, F.lit("/"), name)).otherwise(F.concat(folder, name))
    created = F.col("event_type").isin("click", "view", "purchase")
    # Every 16th event names the file in its url only.
    subject = F.when(e % 16 == 15, F.lit("/other")).otherwise(
        F.concat(F.lit(subject_prefix(CONTAINER)), path)
    )
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("id"),
        subject.alias("subject"),
        F.when(created, CREATED_EVENT)
        .otherwise("Microsoft.Storage.BlobDeleted")
        .alias("eventType"),
        F.struct(
            F.concat(F.lit("https://store.example/blobs/"), path).alias("url"),
            F.when(e % 5 == 0, "text/plain").otherwise("application/pdf").alias("contentType"),
            F.round(F.col("value") * 100000).cast("bigint").alias("contentLength"),
        ).alias("data"),
    )


def _k():
    """Order key of a derived invoice, from its id."""
    return F.substring_index("id", "-", 1).cast("bigint")


def analysis_results(view):
    """Add `result`, the JSON a document analysis would give for each derived invoice.

    Every field comes in one of three forms: typed value, printed text only, or not at all. Every
    29th result has no document.
    """
    k = _k()

    def form(i, typed, printed):
        return F.when((k + i) % 3 == 0, typed).when((k + i) % 3 == 1, printed)

    def text(i, c):
        typed = F.struct(
            F.col(c).alias("value_string"), F.concat(F.lit("printed "), c).alias("content")
        )
        printed = F.struct(F.lit(None).cast("string").alias("value_string"), F.col(c).alias("content"))
        return form(i, typed, printed)

    def date(i, c):
        typed = F.struct(F.col(c).alias("value_date"), F.lit("some day").alias("content"))
        printed = F.struct(F.lit(None).cast("string").alias("value_date"), F.col(c).alias("content"))
        return form(i, typed, printed)

    def money(i, c):
        # Printed amounts of odd orders carry a currency sign and do not read as numbers.
        number = F.col(c).cast("string")
        shown = F.when(k % 2 == 1, F.concat(F.lit("$"), number)).otherwise(number)
        currency = F.struct(F.col(c).alias("amount"))
        typed = F.struct(currency.alias("value_currency"), F.lit("n/a").alias("content"))
        nothing = F.lit(None).cast(currency_type)
        printed = F.struct(nothing.alias("value_currency"), shown.alias("content"))
        return form(i, typed, printed)

    currency_type = "struct<amount:double>"

    def item(x):
        return F.struct(
            F.struct(
                F.struct(x["description"].alias("value_string")).alias("Description"),
                F.struct(x["quantity"].alias("value_number")).alias("Quantity"),
                F.struct(F.struct(x["unit_price"].alias("amount")).alias("value_currency")).alias(
                    "UnitPrice"
                ),
                F.struct(x["amount"].cast("string").alias("content")).alias("Amount"),
                F.struct(x["unit"].alias("value_string")).alias("Unit"),
                F.struct(x["product_code"].alias("content")).alias("ProductCode"),
            ).alias("value_object")
        )

    fields = F.struct(
        text(0, "vendor_name").alias("VendorName"),
        text(1, "customer_name").alias("CustomerName"),
        text(2, "invoice_number").alias("InvoiceId"),
        date(0, "invoice_date").alias("InvoiceDate"),
        date(1, "due_date").alias("DueDate"),
        text(0, "purchase_order").alias("PurchaseOrder"),
        money(2, "total_amount").alias("InvoiceTotal"),
        money(1, "subtotal").alias("SubTotal"),
        money(0, "total_tax").alias("TotalTax"),
        text(1, "currency").alias("CurrencyCode"),
        F.struct(F.transform("line_items", item).alias("value_array")).alias("Items"),
    )
    document = F.struct(
        F.col("classification_confidence").alias("confidence"), fields.alias("fields")
    )
    pages = F.transform(
        F.sequence(F.lit(1), F.col("page_count")), lambda p: F.struct(p.alias("page_number"))
    )
    result = F.struct(
        F.col("raw_text").alias("content"),
        pages.alias("pages"),
        F.when(k % 29 != 0, F.array(document)).alias("documents"),
    )
    return view.withColumn("result", F.to_json(result))


RESULT_COLUMNS = [
    "id", "vendor_name", "customer_name", "invoice_number", "invoice_date", "due_date",
    "purchase_order", "total_amount", "subtotal", "total_tax", "currency", "line_items",
    "classification_confidence", "page_count", "raw_text",
]


def model_replies(view):
    """Add `reply`, the JSON a classifier would give: every 13th lacks fields, every 17th names a
    category outside the list, every 19th is missing."""
    k = _k()
    full = F.struct(
        F.when(k % 17 == 0, "Gardening").otherwise(F.col("spend_category")).alias("spend_category"),
        F.col("subcategory").alias("subcategory"),
        F.col("is_likely_duplicate").alias("is_likely_duplicate"),
        F.col("anomaly_flags").alias("anomaly_flags"),
        F.col("classification_confidence").alias("confidence"),
        F.col("classification_reasoning").alias("reasoning"),
    )
    partial = F.struct(F.col("spend_category").alias("spend_category"))
    return view.withColumn(
        "reply",
        F.when(k % 19 == 0, None).when(k % 13 == 0, F.to_json(partial)).otherwise(F.to_json(full)),
    )


REPLY_COLUMNS = [
    "id", "spend_category", "subcategory", "is_likely_duplicate", "anomaly_flags",
    "classification_confidence", "classification_reasoning",
]


def change_set(spark, sf_dir):
    """Edits for the invoices classified with little confidence: a new category and a note; a
    blank purchase order leaves the category as it is."""
    low = invoices(
        spark, sf_dir, "id", "user_id", "classification_confidence", "purchase_order"
    ).filter("classification_confidence < 0.2")
    return low.select(
        "id",
        "user_id",
        F.when(F.col("purchase_order") != "", F.lit("Other")).alias("spend_category"),
        F.concat(F.lit("checked "), "id").alias("notes"),
    )


def budgets(spark, sf_dir):
    """A budget per month of the processed spend: 0.8 + month / 20 of it. The month 1996-03 has
    none, 1997-07 has one of zero."""
    month = F.substring("invoice_date", 1, 7)
    spend = (
        invoices(spark, sf_dir, "status", "invoice_date", "total_amount")
        .filter("status = 'processed' and invoice_date rlike '^[0-9]{4}-'")
        .groupBy(month.alias("period"))
        .agg(money_sum("total_amount").alias("spend"))
    )
    factor = 0.8 + F.substring("period", 6, 2).cast("int") / 20
    return spend.filter("period <> '1996-03'").select(
        "period",
        F.lit("all").alias("department"),
        F.when(F.col("period") == "1997-07", 0.0)
        .otherwise(F.col("spend") * factor)
        .alias("amount"),
    )


def quarter_budgets(spark, sf_dir):
    """A budget per quarter with processed spend, for every category in it and for all together:
    100,000, 200,000 or 300,000 by the length of the department's name."""
    dated = invoices(spark, sf_dir, "status", "invoice_date", "spend_category").filter(
        "status = 'processed' and invoice_date rlike '^[0-9]{4}-'"
    )
    day = F.to_date("invoice_date")
    period = F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    departments = F.array_compact(F.array(F.lit("all"), F.col("spend_category")))
    return (
        dated.select(period.alias("period"), F.explode(departments).alias("department"))
        .distinct()
        .withColumn("amount", 100000.0 * (1 + F.length("department") % 3))
    )


def stored_results(spark, sf_dir):
    """Analysis results per file path for the events' files: order `k` is the document of event
    `k`. Every 13th file has no result."""
    from ledgerloom.functions.intake import blob_name

    paths = file_events(spark, sf_dir).select(
        "id", blob_name("subject", F.col("data.url")).alias("blob_path")
    )
    key = F.col("id").try_cast("bigint")
    present = paths.filter(key % 13 != 0).select(key.alias("o_orderkey"), "blob_path")
    renamed = present.withColumnRenamed("blob_path", "file_path")
    records = invoices(spark, sf_dir, *RESULT_COLUMNS, copies=False, files=renamed)
    return analysis_results(records.withColumnRenamed("file_path", "blob_path")).select("blob_path", "result")
