"""Explicit schemas. Nothing in the library infers a schema from data."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields):
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


_STR, _DBL = StringType(), DoubleType()

# The ten spend categories, in definition order.
SPEND_CATEGORIES = [
    "IT",
    "Marketing",
    "Facilities",
    "Travel",
    "HR",
    "Legal",
    "Consulting",
    "Supplies",
    "Utilities",
    "Other",
]

LINE_ITEM = _struct(
    description=_STR,
    quantity=_DBL,
    unit_price=_DBL,
    amount=_DBL,
    unit=_STR,
    product_code=_STR,
    tax=_DBL,
)

# The master invoice record: the declared columns plus the six the record carries besides. Fixed
# values: names, order and types.
INVOICE = _struct(
    id=_STR,
    user_id=_STR,
    source=_STR,
    blob_path=_STR,
    status=_STR,
    vendor_name=_STR,
    vendor_address=_STR,
    customer_name=_STR,
    invoice_number=_STR,
    invoice_date=_STR,
    due_date=_STR,
    purchase_order=_STR,
    total_amount=_DBL,
    subtotal=_DBL,
    total_tax=_DBL,
    currency=_STR,
    spend_category=_STR,
    subcategory=_STR,
    is_likely_duplicate=BooleanType(),
    anomaly_flags=ArrayType(_STR),
    classification_confidence=_DBL,
    classification_reasoning=_STR,
    page_count=IntegerType(),
    processed_at=_STR,
    correlation_id=_STR,
    line_items=ArrayType(LINE_ITEM),
    extraction_model=_STR,
    classification_model=_STR,
    raw_text=_STR,
    tags=ArrayType(_STR),
    notes=_STR,
)

# Queue message, one per accepted file. Names, order and types.
MESSAGE = _struct(
    blob_path=_STR,
    container_name=_STR,
    user_id=_STR,
    source=_STR,
    upload_id=_STR,
    correlation_id=_STR,
    content_type=_STR,
    file_size_bytes=LongType(),
)

# File event as delivered by the storage notification. Names. The length is read as
# text and parsed with the library's own rule.
EVENT = _struct(
    id=_STR,
    subject=_STR,
    eventType=_STR,
    data=_struct(url=_STR, contentType=_STR, contentLength=_STR),
)

# Model reply arguments.
CLASSIFICATION = _struct(
    spend_category=_STR,
    subcategory=_STR,
    is_likely_duplicate=BooleanType(),
    anomaly_flags=ArrayType(_STR),
    confidence=_DBL,
    reasoning=_STR,
)

_CURRENCY = _struct(amount=_STR)
_ITEM_FIELD = _struct(
    value_string=_STR, content=_STR, value_currency=_CURRENCY, value_number=_STR
)
_ITEM = _struct(
    value_object=_struct(
        Description=_ITEM_FIELD,
        Quantity=_ITEM_FIELD,
        UnitPrice=_ITEM_FIELD,
        Amount=_ITEM_FIELD,
        Unit=_ITEM_FIELD,
        ProductCode=_ITEM_FIELD,
        Tax=_ITEM_FIELD,
    )
)
_FIELD = _struct(
    value_string=_STR, content=_STR, value_currency=_CURRENCY, value_date=_STR
)

# Document-analysis output. Numbers are read as text and parsed with the library's own rule.
EXTRACTION = _struct(
    content=_STR,
    pages=ArrayType(_struct(page_number=IntegerType())),
    documents=ArrayType(
        _struct(
            confidence=_DBL,
            fields=_struct(
                VendorName=_FIELD,
                VendorAddress=_FIELD,
                CustomerName=_FIELD,
                CustomerAddress=_FIELD,
                InvoiceId=_FIELD,
                InvoiceDate=_FIELD,
                DueDate=_FIELD,
                PurchaseOrder=_FIELD,
                InvoiceTotal=_FIELD,
                SubTotal=_FIELD,
                TotalTax=_FIELD,
                CurrencyCode=_FIELD,
                Items=_struct(value_array=ArrayType(_ITEM)),
            ),
        )
    ),
    _corrupt=_STR,
)
