"""SQL statements that give the registered queries' results on the same tables.

They restate the rules on their own: duplicates by `EXISTS`, per-vendor figures by windows, chunks by
a recursive query, search scores by a join of words.
"""

USER = "user3"
SEARCH_QUERY = "theron ouan sharon: eneux"

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
KEYWORD_RULES = [
    ("software", "IT", 3),
    ("laptop", "IT", 2),
    ("advertising", "Marketing", 3),
    ("campaign", "Marketing", 2),
    ("cleaning", "Facilities", 3),
    ("rent", "Facilities", 1),
    ("flight", "Travel", 3),
    ("hotel", "Travel", 2),
    ("recruiting", "HR", 3),
    ("training", "HR", 1),
    ("contract review", "Legal", 3),
    ("attorney", "Legal", 3),
    ("advisory", "Consulting", 3),
    ("consulting", "Consulting", 2),
    ("paper", "Supplies", 2),
    ("toner", "Supplies", 3),
    ("electricity", "Utilities", 3),
    ("water", "Utilities", 1),
]


def _list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


# The derived invoice records ----------------------------------------------------------------------

_ITEMS = "(CASE WHEN k % 30 = 0 THEN 25 ELSE k % 6 END)"
_CENTS = "CAST(round(price * 100) AS BIGINT)"


def _item(i):
    """Expressions for line item `i` of order `k`."""
    n = f"greatest({_ITEMS}, 1)"
    amount = f"(({_CENTS} * {i}) // {n} - ({_CENTS} * ({i} - 1)) // {n})"
    quantity = f"(1 + (k + {i}) % 9)"
    return {
        "description": f"CASE WHEN (k + {i}) % 17 = 0 THEN '' "
        f"ELSE {_list(ITEM_WORDS)}[(k + {i}) % 10 + 1] || ' ' || {i} END",
        "quantity": f"CAST({quantity} AS DOUBLE)",
        "unit_cents": f"({amount} // {quantity})",
        "unit_price": f"(({amount} // {quantity}) / 100.0::DOUBLE)",
        "amount_cents": amount,
        "amount": f"({amount} / 100.0::DOUBLE)",
        "unit": f"CASE WHEN {i} % 2 = 0 THEN 'ea' ELSE '' END",
        "product_code": f"'P-' || ((k + {i}) % 100)",
        "tax": f"CASE WHEN {i} % 3 <> 0 THEN (({amount} * 8) // 100) / 100.0::DOUBLE END",
    }


_INV = f"""
lines AS (
  SELECT l_orderkey, min(l_suppkey) AS suppkey,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS subtotal,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)
                  * CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 10000 AS total_tax
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS price,
         CAST(o_orderdate AS DATE) AS d, 'user' || (o_custkey % 20) AS user_id,
         s_name, c_name, subtotal, total_tax, text AS raw_text
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey
  LEFT JOIN supplier ON s_suppkey = suppkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN documents ON doc_id = o_orderkey),
copies AS (
  SELECT *, 0 AS copy FROM base
  UNION ALL SELECT *, 1 FROM base WHERE k % 150 = 0
  UNION ALL SELECT *, 2 FROM base WHERE k % 40 = 7),
inv AS (
  SELECT k, price, user_id, raw_text, subtotal, total_tax, c_name AS customer_name,
    CASE WHEN copy = 2 THEN k || '-d' ELSE CAST(k AS VARCHAR) END AS id,
    CASE WHEN k % 4 = 0 THEN 'email' ELSE 'upload' END AS source,
    CASE WHEN k % 4 = 0 THEN 'email/m' || k || '/inv.pdf'
         ELSE user_id || '/u' || k || '/inv.pdf' END AS blob_path,
    CASE WHEN s = 'P' AND k % 3 = 0 THEN 'failed' ELSE 'processed' END AS status,
    CASE WHEN k % 3 = 1 THEN '  ' || lower(s_name) || ' '
         WHEN k % 3 = 2 THEN upper(s_name) ELSE s_name END AS vendor_name,
    '' AS vendor_address, 'INV-' || k AS invoice_number,
    CASE WHEN k % 50 = 7 THEN '' WHEN k % 50 = 8 THEN 'Jan 5'
         ELSE CAST(d AS VARCHAR) END AS invoice_date,
    CASE WHEN k % 30 = 3 THEN '' ELSE CAST(d + CAST(k % 75 AS INTEGER) AS VARCHAR) END AS due_date,
    CASE WHEN k % 7 = 0 THEN '' ELSE 'PO-' || k END AS purchase_order,
    CASE WHEN k % 97 = 0 THEN NULL WHEN k % 40 = 0 THEN price * 10 ELSE price END AS total_amount,
    {_list([None, "usd", " eur ", "GBP", "xyz", ""])}[k % 6 + 1] AS currency,
    CASE WHEN k % 101 = 0 THEN NULL ELSE {_list(SPEND_CATEGORIES)}[k % 10 + 1] END
      AS spend_category,
    'sub' || (k % 3) AS subcategory,
    CASE k % 20 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS is_likely_duplicate,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 8 = 0 THEN 2 WHEN k % 4 = 0 THEN 1 ELSE 0 END
      AS flag_count,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 8 = 0 THEN 'round_number,missing_po'
         WHEN k % 4 = 0 THEN 'round_number' ELSE '' END AS anomaly_flags,
    (k % 100) / 100.0::DOUBLE AS classification_confidence,
    'because ' || (k % 10) AS classification_reasoning,
    CAST(1 + k % 5 AS INTEGER) AS page_count,
    CASE WHEN copy = 2 THEN CAST(d + 1 AS VARCHAR) || 'T00:00:00+00:00'
         ELSE CAST(d AS VARCHAR) || 'T' || lpad(CAST(k % 24 AS VARCHAR), 2, '0')
              || ':00:00+00:00' END AS processed_at,
    'c' || k AS correlation_id, 'prebuilt-invoice' AS extraction_model,
    '' AS classification_model, '' AS tags, '' AS notes
  FROM copies)"""

_MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def _sum(c):
    return _MONEY.format(c)


def _avg(c):
    return f"{_MONEY.format(c)} / count({c})"


def _over(c, key):
    """Exact sum over a window."""
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) OVER (PARTITION BY {key}) AS DOUBLE)"


_BRONZE = """
bronze AS (
  SELECT * EXCLUDE (rn, currency), upper(coalesce(currency, 'USD')) AS currency,
    TRY_CAST(invoice_date AS DATE) AS invoice_date_parsed,
    TRY_CAST(due_date AS DATE) AS due_date_parsed,
    upper(trim(vendor_name, ' ')) AS vendor_name_clean
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY processed_at DESC) AS rn
        FROM inv WHERE status = 'processed')
  WHERE rn = 1)"""

_SILVER = f"""
silver AS (
  SELECT *, total_amount > vendor_avg_amount * 3 AS above
  FROM (
    SELECT *,
      CAST(year(invoice_date_parsed) AS INTEGER) AS fiscal_year,
      CAST(quarter(invoice_date_parsed) AS INTEGER) AS fiscal_quarter,
      CAST(month(invoice_date_parsed) AS INTEGER) AS fiscal_month,
      year(invoice_date_parsed) || '-Q' || quarter(invoice_date_parsed) AS fiscal_period,
      count(id) OVER (PARTITION BY vendor_name_clean) AS vendor_invoice_count,
      {_over("total_amount", "vendor_name_clean")} AS vendor_total_spend,
      {_over("total_amount", "vendor_name_clean")}
        / count(total_amount) OVER (PARTITION BY vendor_name_clean) AS vendor_avg_amount,
      CAST(coalesce(flag_count, 0) AS INTEGER) AS anomaly_count,
      CAST(due_date_parsed - invoice_date_parsed AS INTEGER) AS days_to_due
    FROM bronze))"""


def _inv(sql, *more):
    return "WITH RECURSIVE " + ",".join([_INV, *more]) + sql


def _silver(sql):
    return _inv(sql, _BRONZE, _SILVER)


_ANOMALIES = """
SELECT id, vendor_name_clean, total_amount, spend_category,
  CAST(invoice_date_parsed AS VARCHAR) AS invoice_date_parsed, anomaly_flags, anomaly_count,
  is_likely_duplicate, coalesce(above, FALSE) AS is_high_value
FROM silver WHERE anomaly_count > 0"""


# Extraction results -------------------------------------------------------------------------------


def _text_form(i, c):
    return (
        f"CASE WHEN k % 29 = 0 THEN '' WHEN (k + {i}) % 3 = 0 AND {c} = '' THEN 'printed ' "
        f"WHEN (k + {i}) % 3 < 2 THEN coalesce({c}, '') ELSE '' END"
    )


def _date_form(i, c):
    return (
        f"CASE WHEN k % 29 = 0 THEN '' WHEN (k + {i}) % 3 = 0 AND {c} = '' THEN 'some day' "
        f"WHEN (k + {i}) % 3 < 2 THEN coalesce({c}, '') ELSE '' END"
    )


def _money_form(i, c):
    return (
        f"CASE WHEN k % 29 = 0 THEN NULL WHEN (k + {i}) % 3 = 0 THEN {c} "
        f"WHEN (k + {i}) % 3 = 1 AND k % 2 = 0 THEN {c} END"
    )


_EXTRACTED = f"""
extracted AS (
  SELECT id, k, price,
    {_text_form(0, "vendor_name")} AS vendor_name,
    {_text_form(1, "customer_name")} AS customer_name,
    {_text_form(2, "invoice_number")} AS invoice_number,
    {_date_form(0, "invoice_date")} AS invoice_date,
    {_date_form(1, "due_date")} AS due_date,
    {_text_form(0, "purchase_order")} AS purchase_order,
    {_money_form(2, "total_amount")} AS total_amount,
    {_money_form(1, "subtotal")} AS subtotal,
    {_money_form(0, "total_tax")} AS total_tax,
    coalesce(nullif({_text_form(1, "currency")}, ''), 'USD') AS currency,
    page_count, coalesce(raw_text, '') AS raw_text,
    CASE WHEN k % 29 = 0 THEN 0.0 ELSE classification_confidence END AS confidence,
    CASE WHEN k % 29 = 0 THEN 0 ELSE {_ITEMS} END AS item_count
  FROM inv)"""

_I = _item("i")


def _item_list(expression, separator):
    return (
        "coalesce(array_to_string(list_transform(range(1, item_count + 1), "
        f"lambda i: {expression}), '{separator}'), '')"
    )


# Keyword rules ------------------------------------------------------------------------------------


def _weight(category, text):
    terms = [(t, w) for t, c, w in KEYWORD_RULES if c == category]
    return " + ".join(
        ["0"] + [f"CASE WHEN contains({text}, '{t}') THEN {w} ELSE 0 END" for t, w in terms]
    )


def _rules(source):
    """Best category per row of `source`, which has a column `txt`."""
    ranked = " UNION ALL ".join(
        f"SELECT *, {i} AS r, '{c}' AS cat, {_weight(c, 'txt')} AS w FROM {source}"
        for i, c in enumerate(SPEND_CATEGORIES)
    )
    return f"""(
  SELECT * EXCLUDE (cat), CASE WHEN w > 0 THEN cat ELSE 'Other' END AS rule_category,
         row_number() OVER (PARTITION BY id, copy_number ORDER BY w DESC, r) AS best
  FROM ({ranked}))"""


# Chunks and words ---------------------------------------------------------------------------------


def _chunks(source, key):
    """Chunks of `text` per `key`, from a recursive query over the rest of each text."""
    window = "substring(rest, 1, 4000)"
    last = rf"(4000 - length(regexp_extract({window}, '[^\n]*$')))"
    return f"""
cut AS (
  SELECT {key}, CAST(-1 AS BIGINT) AS chunk_id, '' AS content, text AS rest
  FROM {source} WHERE regexp_matches(text, '\\S')
  UNION ALL
  SELECT {key}, chunk_id + 1, substring(rest, 1, n), substring(rest, n + 1)
  FROM (SELECT *, CASE WHEN length(rest) <= 4000 THEN length(rest)
                       WHEN {last} > 2001 THEN {last} ELSE 4000 END AS n
        FROM cut WHERE length(rest) > 0)),
chunks AS (SELECT {key}, chunk_id, content FROM cut WHERE chunk_id >= 0)"""


_DOCUMENTS = (
    """
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY processed_at DESC) AS rn
                 FROM inv) WHERE rn = 1),
texts AS (SELECT id, raw_text AS text FROM once),"""
    + _chunks("texts", "id")
    + """,
search_docs AS (
  SELECT c.id || ':' || chunk_id AS id, c.id AS invoice_id, CAST(chunk_id AS VARCHAR) AS chunk_id,
         content, vendor_name, invoice_number, spend_category, invoice_date, total_amount, user_id
  FROM chunks c JOIN once i ON i.id = c.id)"""
)

_QUERY_WORDS = "".join(c if c.isalnum() else " " for c in SEARCH_QUERY.lower()).split()


# Every fifth order's text was cut when it was indexed again.
_CUT_DOCUMENTS = _DOCUMENTS.replace(
    "SELECT id, raw_text AS text FROM once",
    "SELECT id, CASE WHEN k % 5 = 0 THEN substring(raw_text, 1, 100) ELSE raw_text END AS text "
    "FROM once",
)


_VECTOR_TOPK = """
WITH parts AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY label, i),
centres AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM means GROUP BY label),
scored AS (
  SELECT query_id, vec_id AS id,
    round(list_cosine_similarity(c, CAST(embedding AS DOUBLE[])), 6) AS score
  FROM centres, embeddings)
SELECT query_id, id, score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM scored)
WHERE rank <= 10"""


def _bm25():
    tf = ", ".join(
        f"len(list_filter(words, lambda w: w = '{word}')) AS tf{i}"
        for i, word in enumerate(_QUERY_WORDS)
    )
    df = ", ".join(
        f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(_QUERY_WORDS))
    )
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 "
        f"/ (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
        for i in range(len(_QUERY_WORDS))
    )
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(_QUERY_WORDS)))
    return f""",
split AS (SELECT *, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS words
          FROM search_docs),
counted AS (SELECT *, len(words) AS dl, {tf} FROM split),
figures AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM counted)
SELECT id, invoice_id, substring(content, 1, 500) AS content, vendor_name, invoice_number,
       spend_category, round(CAST({score} AS DOUBLE), 6) AS score
FROM counted, figures WHERE {hit} ORDER BY score DESC, id LIMIT 10"""


# Events -------------------------------------------------------------------------------------------

_PREFIX = "/blobServices/default/containers/uploads/blobs/"
_EVENTS = f"""
named AS (
  SELECT event_id AS e, event_type IN ('click', 'view', 'purchase') AS created,
    event_id % 16 = 15 AS url_only, CAST(round(value * 100000) AS BIGINT) AS bytes,
    CASE event_id % 8
      WHEN 0 THEN 'user' || user_id || '/e' || event_id || '/file.pdf'
      WHEN 1 THEN 'user' || user_id || '/e' || event_id || '/file.PDF'
      WHEN 2 THEN 'user' || user_id || '/e' || event_id || '/file.png'
      WHEN 3 THEN 'user' || user_id || '/e' || event_id || '/file.tiff'
      WHEN 4 THEN 'user' || user_id || '/e' || event_id || '/file.docx'
      WHEN 5 THEN 'user' || user_id || '/e' || event_id || '/file'
      WHEN 6 THEN 'user' || user_id || '-' || event_id || '/file.pdf'
      ELSE 'email/e' || event_id || '/file.pdf' END AS path
  FROM events),
accepted AS (
  SELECT e, url_only, path AS blob_path, 'uploads' AS container_name,
    CASE WHEN e % 8 = 6 THEN 'unknown' ELSE split_part(path, '/', 1) END AS user_id,
    CASE WHEN e % 8 = 6 THEN 'unknown' WHEN e % 8 = 7 THEN 'email' ELSE 'upload' END AS source,
    CASE WHEN e % 8 = 6 THEN '' ELSE 'e' || e END AS upload_id,
    sha256('message|uploads|' || path) AS correlation_id,
    CASE WHEN e % 5 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS content_type,
    bytes AS file_size_bytes
  FROM named WHERE created AND e % 8 NOT IN (4, 5))"""
_MESSAGE = """blob_path, container_name, user_id, source, upload_id, correlation_id, content_type,
  file_size_bytes"""

_INVOICE_FLAT = """id, user_id, source, blob_path, status, vendor_name, vendor_address,
  customer_name, invoice_number, invoice_date, due_date, purchase_order, total_amount, subtotal,
  total_tax, currency, spend_category, subcategory, is_likely_duplicate, anomaly_flags,
  classification_confidence, classification_reasoning, page_count, processed_at, correlation_id,
  extraction_model, classification_model"""

_EARLIER = """n.vendor_name = e.vendor_name AND n.vendor_name <> ''
  AND (n.total_amount IS NULL OR n.total_amount = e.total_amount)
  AND (n.invoice_date = '' OR n.invoice_date = e.invoice_date)
  AND (e.processed_at, e.id) < (n.processed_at, n.id)"""


def _summary(label, where="", user=USER):
    of_user = f"AND user_id = '{user}'" if user else ""
    return _inv(f"""
SELECT {label} AS label, count(*) AS count, {_sum("total_amount")} AS total
FROM inv WHERE status = 'processed' {of_user} {where} GROUP BY 1""")


def _money_text(c, missing):
    return f"coalesce('$' || format('{{:,.2f}}', {c}), '{missing}')"


_CONTEXT_ITEM = (
    "'  ' || i || '. ' || {description} || ' | qty=' || {quantity} || ' | unit_price=' "
    "|| {unit_price} || ' | amount=' || {amount}"
).format(**{name: f"({sql})" for name, sql in _I.items()})

_RECORDS = f"""
described AS (
  SELECT sha256('uploads|' || a.blob_path) AS id, 0 AS copy_number, a.user_id, a.source,
    a.blob_path, CASE WHEN x.id IS NULL THEN 'failed' ELSE 'processed' END AS status,
    x.vendor_name, x.invoice_date, x.total_amount, x.currency, x.page_count, x.purchase_order,
    x.raw_text, a.e % 2 AS delivery,
    lower(concat_ws(' ', x.vendor_name, {_item_list(_I["description"], " ")})) AS txt
  FROM accepted a LEFT JOIN (SELECT DISTINCT * FROM extracted) x
    ON x.id = CAST(a.e AS VARCHAR) AND a.e % 13 <> 0
  WHERE NOT a.url_only),
records AS (SELECT * FROM {_rules("described")} WHERE best = 1)"""

ORACLE = {
    "scan_invoices": _inv(f"""
SELECT {_INVOICE_FLAT}, tags, notes, CAST({_ITEMS} AS INTEGER) AS item_count,
       md5(raw_text) AS text_md5 FROM inv"""),
    "landing_audit": """
SELECT o_orderkey, o_orderstatus, o_totalprice, 'orders.parquet' AS source_file, TRUE AS has_time
FROM orders""",
    "bronze": _inv(
        """
SELECT id, user_id, vendor_name_clean, CAST(invoice_date_parsed AS VARCHAR) AS invoice_date_parsed,
  CAST(due_date_parsed AS VARCHAR) AS due_date_parsed,
  CAST(epoch(CAST(replace(left(processed_at, 19), 'T', ' ') AS TIMESTAMP)) AS BIGINT)
    AS processed_at_seconds,
  total_amount, subtotal, total_tax, currency FROM bronze""",
        _BRONZE,
    ),
    "bronze_dedup": _inv("""
SELECT id, min(user_id) AS user_id, max(processed_at) AS processed_at, count(*) AS copies
FROM inv WHERE status = 'processed' GROUP BY id"""),
    "silver": _silver("""
SELECT id, vendor_name_clean, fiscal_year, fiscal_quarter, fiscal_month, fiscal_period,
  anomaly_count, coalesce(above, FALSE) AS is_high_value, days_to_due FROM silver"""),
    "silver_vendor_window": _silver("""
SELECT id, vendor_name_clean, vendor_invoice_count, vendor_total_spend, vendor_avg_amount
FROM silver"""),
    "spend_by_category": _silver(f"""
SELECT fiscal_year, fiscal_quarter, fiscal_month, spend_category, count(id) AS invoice_count,
  {_sum("total_amount")} AS total_spend, {_avg("total_amount")} AS avg_invoice_amount,
  min(total_amount) AS min_invoice_amount, max(total_amount) AS max_invoice_amount,
  CAST(sum(CASE WHEN is_likely_duplicate THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_count,
  CAST(sum(anomaly_count) AS BIGINT) AS total_anomaly_flags
FROM silver GROUP BY ALL"""),
    "vendor_analysis": _silver(f"""
SELECT vendor_name_clean, spend_category, count(id) AS invoice_count,
  {_sum("total_amount")} AS total_spend, {_avg("total_amount")} AS avg_invoice_amount,
  CAST(min(invoice_date_parsed) AS VARCHAR) AS first_invoice_date,
  CAST(max(invoice_date_parsed) AS VARCHAR) AS last_invoice_date,
  avg(days_to_due) AS avg_days_to_due,
  CAST(sum(CASE WHEN is_likely_duplicate THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_count
FROM silver GROUP BY vendor_name_clean, spend_category"""),
    "monthly_trend": _silver(f"""
SELECT fiscal_year, fiscal_month, count(id) AS invoice_count, {_sum("total_amount")} AS total_spend,
  count(DISTINCT vendor_name_clean) AS unique_vendors,
  CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies
FROM silver GROUP BY fiscal_year, fiscal_month"""),
    "anomaly_summary": _silver(_ANOMALIES),
    "change_feed": _inv(
        """
SELECT id, CASE WHEN k % 7 = 0 THEN 'insert' ELSE 'update' END AS _change, total_amount, spend_category
FROM once WHERE k % 7 = 0 OR (k % 5 = 1
  AND (total_amount IS DISTINCT FROM total_amount * 3 + 50 OR spend_category IS DISTINCT FROM 'Other'))
UNION ALL SELECT 'gone-' || id, 'delete', total_amount, spend_category FROM once WHERE k % 11 = 2""",
        " once AS (SELECT * FROM inv QUALIFY row_number() OVER (PARTITION BY id ORDER BY processed_at) = 1)",
    ),
    "gold_incremental": _silver(f"""
SELECT 'spend_by_category' AS table_name, concat_ws('|', fiscal_year, fiscal_month, spend_category) AS key,
  count(id) AS invoice_count, {_sum("total_amount")} AS total_spend, min(total_amount) AS low,
  max(total_amount) AS high, {_avg("total_amount")} AS average,
  CAST(sum(CASE WHEN is_likely_duplicate THEN 1 ELSE 0 END) AS BIGINT) AS duplicates,
  CAST(sum(anomaly_count) AS BIGINT) AS flags, CAST(NULL AS DOUBLE) AS days,
  CAST(NULL AS VARCHAR) AS first, CAST(NULL AS VARCHAR) AS last, CAST(NULL AS BIGINT) AS vendors
FROM silver GROUP BY fiscal_year, fiscal_quarter, fiscal_month, spend_category
UNION ALL SELECT 'vendor_analysis', concat_ws('|', vendor_name_clean, spend_category), count(id),
  {_sum("total_amount")}, NULL, NULL, {_avg("total_amount")},
  CAST(sum(CASE WHEN is_likely_duplicate THEN 1 ELSE 0 END) AS BIGINT), NULL, avg(days_to_due),
  CAST(min(invoice_date_parsed) AS VARCHAR), CAST(max(invoice_date_parsed) AS VARCHAR), NULL
FROM silver GROUP BY vendor_name_clean, spend_category
UNION ALL SELECT 'monthly_trend', concat_ws('|', fiscal_year, fiscal_month), count(id),
  {_sum("total_amount")}, NULL, NULL, NULL, NULL, CAST(sum(anomaly_count) AS BIGINT), NULL, NULL, NULL,
  count(DISTINCT vendor_name_clean)
FROM silver GROUP BY fiscal_year, fiscal_month"""),
    "gold_incremental_anomalies": _silver(_ANOMALIES),
    "medallion_batch": _silver(f"""
SELECT 'raw_invoices' AS table_name, user_id AS key, count(*) AS number,
  {_sum("total_amount")} AS amount, TRUE AS counted FROM inv GROUP BY user_id
UNION ALL SELECT 'invoices_bronze', user_id, count(*), {_sum("total_amount")}, TRUE
  FROM bronze GROUP BY user_id
UNION ALL SELECT 'invoices_silver', concat_ws('|', vendor_name_clean), count(*),
  {_sum("total_amount")}, TRUE FROM silver GROUP BY 2
UNION ALL SELECT 'spend_by_category', concat_ws('|', fiscal_year, fiscal_month, spend_category),
  count(id), {_sum("total_amount")}, TRUE FROM silver GROUP BY fiscal_year, fiscal_month, spend_category
UNION ALL SELECT 'vendor_analysis', concat_ws('|', vendor_name_clean, spend_category), count(id),
  {_sum("total_amount")}, TRUE FROM silver GROUP BY vendor_name_clean, spend_category
UNION ALL SELECT 'monthly_trend', concat_ws('|', fiscal_year, fiscal_month), count(id),
  {_sum("total_amount")}, TRUE FROM silver GROUP BY fiscal_year, fiscal_month
UNION ALL SELECT 'anomaly_summary', id, CAST(anomaly_count AS BIGINT), total_amount, TRUE
  FROM silver WHERE anomaly_count > 0"""),
    "gold_ordered": _silver("""
SELECT row_number() OVER (ORDER BY fiscal_year NULLS FIRST, fiscal_month NULLS FIRST,
                          spend_category NULLS FIRST) AS place, *
FROM (SELECT fiscal_year, fiscal_month, spend_category, count(id) AS invoice_count
      FROM silver GROUP BY fiscal_year, fiscal_month, spend_category)"""),
    "gold_ordered_by_spend": _silver(f"""
SELECT row_number() OVER (ORDER BY total_spend DESC NULLS LAST) AS place, total_spend
FROM (SELECT {_sum("total_amount")} AS total_spend
      FROM silver GROUP BY vendor_name_clean, spend_category)"""),
    "spend_summary_category": _summary("spend_category"),
    "spend_summary_vendor": _summary("vendor_name"),
    "spend_summary_month": _summary("substring(invoice_date, 1, 7)"),
    "spend_summary_range": _summary(
        "spend_category", "AND invoice_date >= '1996-01-15' AND invoice_date <= '1998-06-30'"
    ),
    "dashboard_totals": _inv(f"""
SELECT count(*) FILTER (WHERE status = 'processed') AS total_invoices,
  coalesce({_sum("CASE WHEN status = 'processed' THEN total_amount END")}, 0.0) AS total_spend,
  count(*) FILTER (WHERE flag_count > 0) AS anomaly_count
FROM inv WHERE user_id = '{USER}'"""),
    "dashboard_by_category": _summary("spend_category", user=None),
    "category_share": _inv(f"""
SELECT label, count, total, share, label || ' (' || CAST(round(share * 100) AS BIGINT) || '%)'
  AS share_label
FROM (SELECT *, total / CAST(sum(CAST(total AS DECIMAL(18,2))) OVER () AS DOUBLE) AS share
      FROM (SELECT spend_category AS label, count(*) AS count, {_sum("total_amount")} AS total
            FROM inv WHERE status = 'processed' AND user_id = '{USER}' GROUP BY 1))"""),
    "list_invoices": _inv(f"""
SELECT id, vendor_name AS vendor, total_amount AS amount, spend_category AS category,
  invoice_date AS date, status
FROM inv WHERE user_id = '{USER}' ORDER BY processed_at DESC, id LIMIT 20 OFFSET 40"""),
    "list_invoices_after": _inv(f""",
last AS (SELECT processed_at AS t, id AS i FROM inv WHERE user_id = '{USER}'
         ORDER BY processed_at DESC, id LIMIT 1 OFFSET 14)
SELECT id, vendor_name AS vendor, total_amount AS amount, spend_category AS category,
  invoice_date AS date, status
FROM inv, last WHERE user_id = '{USER}' AND (processed_at < t OR (processed_at = t AND id > i))
ORDER BY processed_at DESC, id LIMIT 20"""),
    "recent_invoices": _inv(f"""
SELECT id, coalesce(nullif(vendor_name, ''), 'Unknown') AS vendor_name, total_amount,
  coalesce(nullif(spend_category, ''), 'N/A') AS spend_category,
  coalesce(nullif(invoice_date, ''), 'N/A') AS invoice_date, status
FROM inv WHERE user_id = '{USER}' ORDER BY processed_at DESC, id LIMIT 10"""),
    "detect_anomalies": _inv(f"""
SELECT id, vendor_name, total_amount, invoice_date, anomaly_flags, is_likely_duplicate,
  spend_category
FROM inv WHERE user_id = '{USER}' AND flag_count > 0 ORDER BY processed_at DESC, id LIMIT 20"""),
    "invoice_detail": _inv(f"""
SELECT {_INVOICE_FLAT}, notes FROM inv
WHERE user_id = '{USER}' AND id = (SELECT min(id) FROM inv WHERE user_id = '{USER}') LIMIT 1"""),
    "review_queue": _inv("""
SELECT id, user_id, spend_category, classification_confidence FROM inv
WHERE classification_confidence < 0.9"""),
    "missing_fields": _inv("""
SELECT id, concat_ws(',', CASE WHEN coalesce(vendor_name, '') = '' THEN 'VendorName' END,
  CASE WHEN coalesce(invoice_number, '') = '' THEN 'InvoiceId' END,
  CASE WHEN total_amount IS NULL THEN 'InvoiceTotal' END) AS missing
FROM inv WHERE coalesce(vendor_name, '') = '' OR coalesce(invoice_number, '') = ''
  OR total_amount IS NULL"""),
    "budget_variance": _inv(f"""
, spend AS (
  SELECT substring(invoice_date, 1, 7) AS period, {_sum("total_amount")} AS actual
  FROM inv WHERE status = 'processed' AND regexp_matches(invoice_date, '^[0-9]{{4}}-') GROUP BY 1),
budget AS (
  SELECT period, actual, CASE WHEN period = '1997-07' THEN 0.0 ELSE
      actual * (0.8::DOUBLE + CAST(substring(period, 6, 2) AS INTEGER) / 20::DOUBLE) END AS budget
  FROM spend WHERE period <> '1996-03')
SELECT period, 'all' AS department, budget, actual,
  CASE WHEN budget <> 0 THEN (actual - budget) / budget * 100 ELSE 0.0 END AS variance_pct
FROM budget"""),
    "budget_variance_quarter": _inv(f"""
, dated AS (
  SELECT year(CAST(invoice_date AS DATE)) || '-Q' || quarter(CAST(invoice_date AS DATE)) AS period,
    spend_category, total_amount
  FROM inv WHERE status = 'processed' AND regexp_matches(invoice_date, '^[0-9]{{4}}-')),
spent AS (
  SELECT period, 'all' AS department, {_sum("total_amount")} AS actual FROM dated GROUP BY 1
  UNION ALL
  SELECT period, spend_category, {_sum("total_amount")} FROM dated
  WHERE spend_category IS NOT NULL GROUP BY 1, 2)
SELECT period, department, budget, coalesce(actual, 0.0) AS actual,
  (coalesce(actual, 0.0) - budget) / budget * 100 AS variance_pct
FROM (SELECT *, CAST(100000 * (1 + length(department) % 3) AS DOUBLE) AS budget FROM spent)"""),
    "display_format": _inv(f"""
SELECT id, coalesce(nullif(vendor_name, ''), 'Unknown') AS vendor_name, invoice_number,
  {_money_text("total_amount", "--")} AS amount,
  {_money_text("total_amount", "$0.00")} AS dashboard_amount,
  coalesce(nullif(spend_category, ''), 'N/A') AS spend_category,
  coalesce(nullif(invoice_date, ''), 'N/A') AS invoice_date, status,
  CASE flag_count WHEN 2 THEN '2 flags' WHEN 1 THEN '1 flag' ELSE '' END AS flags,
  CASE WHEN is_likely_duplicate THEN 'Duplicate' ELSE '' END AS duplicate,
  CAST(round(classification_confidence * 100) AS BIGINT) || '%' AS confidence
FROM inv"""),
    "duplicate_detection": _inv(f"""
SELECT id, processed_at, CASE WHEN hit THEN TRUE ELSE is_likely_duplicate END
    AS is_likely_duplicate,
  CASE WHEN hit THEN concat_ws(',', nullif(anomaly_flags, ''), 'potential_duplicate')
       ELSE anomaly_flags END AS anomaly_flags
FROM (SELECT *, NOT coalesce(is_likely_duplicate, FALSE)
        AND EXISTS (SELECT 1 FROM inv e WHERE {_EARLIER}) AS hit FROM inv n)"""),
    "duplicate_matches": _inv(f"""
SELECT id, match_rank, match_id, invoice_number, total_amount, invoice_date
FROM (
  SELECT n.row_id, n.id, e.id AS match_id, e.invoice_number, e.total_amount, e.invoice_date,
    CAST(row_number() OVER (PARTITION BY n.row_id
                            ORDER BY e.processed_at, e.id, e.row_id) AS INTEGER) AS match_rank
  FROM (SELECT *, row_number() OVER () AS row_id FROM inv) n
  JOIN (SELECT *, row_number() OVER () AS row_id FROM inv) e ON {_EARLIER})
WHERE match_rank <= 5"""),
    "upsert_latest": _inv("""
SELECT DISTINCT id, user_id, processed_at, status, total_amount FROM inv"""),
    "failed_records": f"""
WITH {_EVENTS}
SELECT sha256('uploads|' || blob_path) AS id, user_id, source, blob_path, 'failed' AS status,
  correlation_id, TRUE AS has_time FROM accepted
WHERE e % 13 = 0 OR e NOT IN (SELECT o_orderkey FROM orders)""",
    "apply_updates": _inv("""
SELECT id, user_id, status,
  CASE WHEN classification_confidence < 0.2 AND purchase_order <> '' THEN 'Other'
       ELSE spend_category END AS spend_category,
  CASE WHEN classification_confidence < 0.2 THEN 'checked ' || id ELSE notes END AS notes
FROM inv"""),
    "apply_deletes": _inv(
        "SELECT id, user_id, status, total_amount FROM inv WHERE status <> 'failed'"
    ),
    "chunk_text": f"""
WITH RECURSIVE {_chunks("documents", "doc_id")}
SELECT doc_id, chunk_id, length(content) AS chars, md5(content) AS content_md5 FROM chunks""",
    "search_documents": _inv(
        "SELECT * REPLACE (md5(content) AS content) FROM search_docs", _DOCUMENTS
    ),
    "search_invoices": _inv(_bm25(), _DOCUMENTS),
    "index_write": _inv(
        "SELECT * REPLACE (md5(content) AS content) FROM search_docs", _CUT_DOCUMENTS
    ),
    "search_index_documents": _inv(
        "SELECT * REPLACE (md5(content) AS content) FROM search_docs", _CUT_DOCUMENTS
    ),
    "search_indexed": _inv(_bm25(), _CUT_DOCUMENTS),
    "stored_text_cut": _inv("""
SELECT id, md5(substring(raw_text, 1, 10000)) AS text_md5,
  length(substring(raw_text, 1, 10000)) AS chars FROM inv"""),
    "vector_topk": _VECTOR_TOPK,
    "extract_fields": _inv(
        f"""
SELECT id, vendor_name, customer_name, invoice_number, invoice_date, due_date, purchase_order,
  total_amount, subtotal, total_tax, currency, page_count, confidence,
  FALSE AS extraction_failed, md5(raw_text) AS text_md5,
  {_item_list("concat_ws(':', {description}, CAST({quantity} AS INTEGER), {unit_cents}, "
              "{amount_cents}, {unit}, {product_code})".format(**_I), "|")} AS items
FROM extracted""",
        _EXTRACTED,
    ),
    "line_items_flat": _inv(f"""
SELECT id, CAST(i AS INTEGER) AS item_number,
  CASE WHEN i IS NOT NULL THEN {_I["description"]} END AS description,
  {_I["quantity"]} AS quantity, {_I["unit_price"]} AS unit_price, {_I["amount"]} AS amount,
  CASE WHEN i IS NOT NULL THEN {_I["unit"]} END AS unit, {_I["product_code"]} AS product_code,
  {_I["tax"]} AS tax
FROM inv LEFT JOIN (SELECT unnest(range(1, 26)) AS i) ON i <= {_ITEMS}"""),
    "classification_context": _inv(f"""
SELECT id, 'Vendor: ' || coalesce(vendor_name, 'None')
  || chr(10) || 'Invoice Number: ' || invoice_number || chr(10) || 'Date: ' || invoice_date
  || chr(10) || 'Due Date: ' || due_date
  || chr(10) || 'Total: ' || coalesce(CAST(total_amount AS VARCHAR), 'None') || ' '
  || coalesce(currency, 'None')
  || chr(10) || 'Subtotal: ' || coalesce(CAST(subtotal AS VARCHAR), 'None')
  || chr(10) || 'Tax: ' || coalesce(CAST(total_tax AS VARCHAR), 'None')
  || chr(10) || 'PO: ' || purchase_order || chr(10) || 'Customer: ' || customer_name
  || chr(10) || 'Line Items (' || {_ITEMS} || '):'
  || CASE WHEN {_ITEMS} > 0 THEN chr(10) || array_to_string(list_transform(
       range(1, least({_ITEMS}, 20) + 1), lambda i: {_CONTEXT_ITEM}), chr(10)) ELSE '' END
  || CASE WHEN coalesce(raw_text, '') <> '' THEN chr(10) || chr(10)
       || '--- Raw Text (first 3000 chars) ---' || chr(10) || substring(raw_text, 1, 3000)
     ELSE '' END AS context
FROM inv"""),
    "parse_classification": _inv("""
SELECT id,
  CASE WHEN k % 19 = 0 THEN '' WHEN k % 13 <> 0 AND k % 17 = 0 THEN 'Gardening'
       ELSE coalesce(spend_category, '') END AS spend_category,
  CASE WHEN k % 19 = 0 OR k % 13 = 0 THEN '' ELSE subcategory END AS subcategory,
  CASE WHEN k % 19 = 0 OR k % 13 = 0 THEN FALSE ELSE coalesce(is_likely_duplicate, FALSE) END
    AS is_likely_duplicate,
  CASE WHEN k % 19 = 0 OR k % 13 = 0 THEN '' ELSE coalesce(anomaly_flags, '') END
    AS anomaly_flags,
  CASE WHEN k % 19 = 0 OR k % 13 = 0 THEN 0.0 ELSE classification_confidence END
    AS classification_confidence,
  CASE WHEN k % 19 = 0 OR k % 13 = 0 THEN '' ELSE classification_reasoning END
    AS classification_reasoning,
  k % 19 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND spend_category IS NOT NULL
    AND is_likely_duplicate IS NOT NULL AND anomaly_flags IS NOT NULL AS is_valid
FROM inv"""),
    "classify_rules": _inv(
        f"""
SELECT id, rule_category, w AS rule_weight FROM {_rules("described")} WHERE best = 1""",
        f"""
described AS (
  SELECT id, row_number() OVER () AS copy_number,
    lower(concat_ws(' ', vendor_name, array_to_string(list_transform(range(1, {_ITEMS} + 1),
      lambda i: {_I["description"]}), ' '))) AS txt
  FROM inv)""",
    ),
    "classify_learned": _inv(
        f"""
SELECT d.copy_id AS id, coalesce(learned, rule_category) AS learned_category,
  coalesce(confidence, 0) AS learned_confidence, coalesce(known, 0) AS known_words
FROM (SELECT copy_number, id AS copy_id FROM described) AS d
JOIN (SELECT copy_number, rule_category FROM {_rules("described")} WHERE best = 1) USING (copy_number)
LEFT JOIN picked USING (copy_number)""",
        f"""
described AS (
  SELECT id, k, spend_category, row_number() OVER () AS copy_number,
    lower(concat_ws(' ', vendor_name, array_to_string(list_transform(range(1, {_ITEMS} + 1),
      lambda i: {_I["description"]}), ' '))) AS txt
  FROM inv)""",
        f"""
said AS (
  SELECT copy_number, k, list_position({_list(SPEND_CATEGORIES)}, spend_category) AS rank,
    unnest(list_distinct(regexp_extract_all(txt, '[\\p{{L}}\\p{{N}}]+'))) AS word
  FROM described)""",
        """
counted AS (SELECT word, rank, count(*) AS n FROM said WHERE (k // 7) % 3 <> 0 AND rank > 0 GROUP BY ALL)""",
        """
word_totals AS (SELECT word, sum(n) AS n_all FROM counted GROUP BY word)""",
        """
figures AS (SELECT sum(n) AS total, count(DISTINCT word) AS words FROM counted)""",
        """
ranks AS (SELECT unnest(range(1, 11)) AS rank)""",
        """
rank_totals AS (SELECT rank, coalesce(sum(n), 0) AS n_rank FROM ranks LEFT JOIN counted USING (rank) GROUP BY rank)""",
        """
weights AS (
  SELECT word, rank, CAST(-ln((n_all - coalesce(n, 0) + 1.0::DOUBLE) / (total - n_rank + 1.0::DOUBLE * words))
    AS DECIMAL(18,9)) AS w
  FROM word_totals CROSS JOIN rank_totals LEFT JOIN counted USING (word, rank), figures)""",
        """
summed AS (
  SELECT copy_number, r, CAST(sum(w) AS DECIMAL(38,9)) AS s, count(*) AS known
  FROM (SELECT copy_number, word FROM said) JOIN (SELECT word, rank AS r, w FROM weights) USING (word)
  GROUP BY copy_number, r)""",
        f"""
picked AS (
  SELECT copy_number, known, {_list(SPEND_CATEGORIES)}[r] AS learned,
    round(1 / sum(exp(CAST(s - top AS DOUBLE))) OVER (PARTITION BY copy_number ORDER BY r
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS confidence
  FROM (SELECT *, max(s) OVER (PARTITION BY copy_number) AS top FROM summed)
  QUALIFY row_number() OVER (PARTITION BY copy_number ORDER BY s DESC, r) = 1)""",
    ),
    "anomaly_rules": _inv(f"""
SELECT id, concat_ws(',',
  CASE WHEN total_amount > 3 * a THEN 'unusually_high_amount' END,
  CASE WHEN total_amount <> 0 AND total_amount % 100 = 0 THEN 'round_number' END,
  CASE WHEN dayofweek(TRY_CAST(invoice_date AS DATE)) IN (0, 6) THEN 'weekend_date' END,
  CASE WHEN purchase_order = '' THEN 'missing_po' END) AS rule_flags
FROM (SELECT *, {_over("total_amount", "vendor_name")}
        / count(total_amount) OVER (PARTITION BY vendor_name) AS a FROM inv)"""),
    "anomaly_robust": _inv(
        """
SELECT id, median_amount, round(high + 3 * (high - low), 4) AS high_limit,
  coalesce(total_amount > high + 3 * (high - low), FALSE) AS is_far_out
FROM cleaned LEFT JOIN quartiles ON vendor IS NOT DISTINCT FROM of_vendor""",
        """
cleaned AS (
  SELECT id, total_amount, upper(trim(vendor_name)) AS vendor FROM inv)""",
        """
quartiles AS (
  SELECT vendor AS of_vendor, quantile_disc(total_amount, 0.25) AS low,
    quantile_disc(total_amount, 0.5) AS median_amount, quantile_disc(total_amount, 0.75) AS high
  FROM cleaned WHERE total_amount IS NOT NULL GROUP BY vendor)""",
    ),
    "money_parse": _inv("""
SELECT id, CASE k % 6 WHEN 0 THEN total_amount
    WHEN 2 THEN CASE WHEN total_amount < 1000 THEN total_amount END
    WHEN 3 THEN k / 100::DOUBLE WHEN 5 THEN -total_amount END AS value,
  CASE WHEN k % 6 = 2 THEN 'EUR' WHEN k % 6 = 3 THEN 'GBP' ELSE 'USD' END AS currency,
  regexp_replace(concat_ws('|', id, currency, 'a b/c'), '[^a-zA-Z0-9_|.-]', '_', 'g')
    AS document_id
FROM inv"""),
    "intake_filter": f"""
WITH {_EVENTS} SELECT CAST(e AS VARCHAR) AS id, blob_path FROM accepted WHERE NOT url_only""",
    "intake_parse": f"WITH {_EVENTS} SELECT {_MESSAGE} FROM accepted",
    "upload_accept": f"""
WITH {_EVENTS}
SELECT *, CASE WHEN accepted THEN 'user3/' || upload_id || '/' || filename END AS blob_path
FROM (SELECT CAST(e AS VARCHAR) AS upload_id, '{USER}' AS user_id,
        split_part(path, '/', -1) AS filename,
        CASE WHEN e % 5 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS content_type,
        bytes AS size_bytes, e % 5 <> 0 AND bytes <= 26214400 AS accepted
      FROM named)""",
    "intake_stream": f"WITH {_EVENTS} SELECT {_MESSAGE} FROM accepted WHERE NOT url_only",
    "landing_incremental": _inv("""
SELECT id, user_id, status, processed_at, total_amount, TRUE AS audited FROM inv"""),
    "process_stream": _inv(
        f"""
SELECT id, user_id, source, blob_path, status, vendor_name, invoice_date, total_amount,
  CASE WHEN status = 'failed' THEN NULL WHEN upper(trim(currency)) IN ('EUR', 'GBP')
       THEN upper(trim(currency)) ELSE 'USD' END AS currency,
  CASE WHEN status = 'processed' THEN rule_category END AS spend_category,
  CASE WHEN status = 'processed' THEN hit END AS is_likely_duplicate,
  CASE WHEN status = 'processed' THEN concat_ws(',',
    CASE WHEN total_amount > 3 * a THEN 'unusually_high_amount' END,
    CASE WHEN total_amount <> 0 AND total_amount % 100 = 0 THEN 'round_number' END,
    CASE WHEN dayofweek(TRY_CAST(invoice_date AS DATE)) IN (0, 6) THEN 'weekend_date' END,
    CASE WHEN coalesce(purchase_order, '') = '' THEN 'missing_po' END,
    CASE WHEN hit THEN 'potential_duplicate' END) END AS anomaly_flags, page_count
FROM (SELECT *,
        (SELECT {_sum("v.total_amount")} / count(v.total_amount) FROM records v
         WHERE v.status = 'processed' AND v.delivery <= n.delivery
           AND v.vendor_name = n.vendor_name) AS a,
        EXISTS (SELECT 1 FROM records e WHERE (e.delivery, e.id) < (n.delivery, n.id)
        AND n.vendor_name = e.vendor_name AND n.vendor_name <> ''
        AND (n.total_amount IS NULL OR n.total_amount = e.total_amount)
        AND (n.invoice_date = '' OR n.invoice_date = e.invoice_date)) AS hit
      FROM records n)""",
        _EXTRACTED,
        _EVENTS,
        _RECORDS,
    ),
    "stream_index": _inv(
        """
SELECT r.id || ':' || chunk_id AS id, r.id AS invoice_id, CAST(chunk_id AS VARCHAR) AS chunk_id,
  md5(content) AS content, vendor_name, user_id
FROM chunks JOIN described r USING (id)""",
        _EXTRACTED,
        _EVENTS,
        _RECORDS,
        "texts AS (SELECT id, raw_text AS text FROM described WHERE status = 'processed')",
        _chunks("texts", "id"),
    ),
    "stream_retry": _inv(
        "SELECT id, user_id, blob_path, status, vendor_name, total_amount FROM described",
        _EXTRACTED,
        _EVENTS,
        _RECORDS,
    ),
    "intake_malformed": """
SELECT '{broken ' || event_id AS value FROM events WHERE event_id % 50 = 3""",
    "file_listing": """
SELECT CAST(s_nationkey AS INTEGER) AS nation,
  md5(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS content_md5,
  CAST(sum(strlen(s_name) + 1) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS content_type,
  TRUE AS has_etag
FROM supplier GROUP BY s_nationkey""",
    "export_csv": _inv("""
SELECT id, customer_name, total_amount,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 8 = 0 THEN '["round_number","missing_po"]'
       WHEN k % 4 = 0 THEN '["round_number"]' ELSE '[]' END AS anomaly_flags
FROM inv"""),
    "export_json": _inv("SELECT id, customer_name, total_amount, anomaly_flags FROM inv"),
    "mailbox_filter": """
SELECT event_id, 'User' || (user_id % 7) || '@x.example' AS sender,
  CASE event_id % 8 WHEN 1 THEN 'file.PDF' WHEN 2 THEN 'file.png' ELSE 'file.pdf' END AS filename,
  CAST(round(value * 100000) AS BIGINT) AS size_bytes
FROM events
WHERE event_id % 8 IN (0, 1, 2, 6, 7) AND user_id % 7 <> 3 AND round(value * 100000) <= 5242880""",
}
