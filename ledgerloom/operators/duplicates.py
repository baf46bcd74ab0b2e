"""Finding invoices that repeat an earlier one.

An invoice repeats an earlier one when the vendor is equal, the amount is equal unless the new
invoice has none, and the date is equal unless the new invoice has none. "Earlier" is the order of
`(processed_at, id)`; invoices stored before count as earlier than all new ones.

Which columns must agree thus depends on the new invoice alone. Each invoice is filed under the full
key, and under the wider ones (without amount, date or both) that somebody asks with, the first ones
are kept per key, and each new invoice joins the single key it asks with. No pair of invoices is ever
formed.
"""

from pyspark.sql import functions as F

from ledgerloom.functions.normalize import present
from ledgerloom.operators.latest import first_n_per_key
from ledgerloom.operators.lookup import GROUP, HASH, KEY, join_keyed, join_values, keyed
from ledgerloom.sources.tables import settled

POTENTIAL_DUPLICATE = "potential_duplicate"

# The columns a match and its order depend on.
_MATCHED = ["id", "processed_at", "vendor_name", "total_amount", "invoice_date"]


def _order():
    return F.struct(F.col("_arrival"), F.col("processed_at"), F.col("id"))


def _key(with_amount, with_date):
    def keep(column, dtype, wanted):
        return (F.col(column) if wanted else F.lit(None).cast(dtype)).alias(column)

    return F.struct(
        F.col("vendor_name"),
        keep("total_amount", "double", with_amount),
        keep("invoice_date", "string", with_date),
    )


def _asked_key():
    """The key an invoice asks with; null when it has no vendor."""
    amount, date = F.col("total_amount").isNotNull(), present("invoice_date")
    return F.when(
        present("vendor_name"),
        F.when(amount & date, _key(True, True))
        .when(amount, _key(True, False))
        .when(date, _key(False, True))
        .otherwise(_key(False, False)),
    )


def _asked(new, which):
    asking = keyed(new.filter(which), _asked_key()).filter(F.col(KEY).isNotNull())
    return asking.select(*GROUP).distinct()


def asked_keys(new):
    """The keys the new invoices ask with."""
    return _asked(new, F.lit(True))


def _wide_keys(new):
    """Those of them that leave out the amount or the date; few invoices lack these."""
    return _asked(new, F.col("total_amount").isNull() | ~present("invoice_date"))


def _entries(df, new, *carried):
    """The keys each invoice can be found under, the full key and the wider ones, as two tables;
    `_asks` marks the key a new invoice asks with."""
    amount, date = F.col("total_amount").isNotNull(), present("invoice_date")
    rows = df.filter(present("vendor_name")).withColumn("_arrival", F.lit(int(new)))

    def entry(with_amount, with_date):
        has = (amount if with_amount else F.lit(True)) & (date if with_date else F.lit(True))
        lacks = (F.lit(True) if with_amount else ~amount) & (F.lit(True) if with_date else ~date)
        asks = lacks if new else F.lit(False)
        return F.when(has, F.struct(_key(with_amount, with_date).alias(KEY), asks.alias("_asks")))

    def under(*entries):
        keys = F.inline(F.array_compact(F.array(*entries)))
        return rows.select(_order().alias("_order"), *carried, keys).withColumn(HASH, F.xxhash64(KEY))

    return under(entry(True, True)), under(entry(True, False), entry(False, True), entry(False, False))


def key_table(records):
    """Every key a stored record can be found under, with its place in the order: what a store keeps
    beside its records so that later invoices are compared with narrow rows."""
    full, wide = _entries(records, False)
    return full.unionByName(wide).select(*GROUP, "_order")


def _all_filed(new, stored, settle, filed, *carried):
    """New invoices, and the stored ones somebody asks for, under their keys."""
    wide_keys = settled(_wide_keys(new), settle, "asked-wide-keys")

    def of(df, is_new):
        full, wide = _entries(df, is_new, *carried)
        return full.unionByName(join_keyed(wide, wide_keys, "left_semi"))

    rows = of(new, True)
    if stored is None and filed is None:
        return rows
    asked = settled(asked_keys(new), settle, "asked-keys")
    old = filed(asked).withColumn("_asks", F.lit(False)) if filed else of(stored, False)
    return rows.unionByName(join_keyed(old, asked, "left_semi"))


def mark_duplicates(new, stored=None, settle=False, filed=None):
    """Add `has_earlier_match` to the new invoices.

    They are compared with the stored invoices, if given, and with each other in order. Only keys
    that somebody asks with and that hold two invoices or more take part in the join; with few
    duplicates these are few. With `settle` they are written first, as are the keys a batch asks
    with, so that neither the new nor the stored rows move.

    A store that keeps a `key_table` gives `filed` in place of its invoices: a function from the
    asked keys to the part of the table that can hold them.
    """
    first = (
        _all_filed(new, stored, settle, filed)
        .groupBy(*GROUP)
        .agg(
            F.min("_order").alias("_first"),
            F.count(F.lit(1)).alias("_n"),
            F.bool_or("_asks").alias("_asked"),
        )
        .filter("_asked and _n > 1")
        .select(*GROUP, "_first")
    )
    first = settled(first, settle, "first-of-key")
    earlier = F.col("_first") < _order()
    return (
        join_values(new.withColumn("_arrival", F.lit(1)), _asked_key(), first)
        .withColumn("has_earlier_match", F.coalesce(earlier, F.lit(False)))
        .drop("_first", "_arrival")
    )


def flag_duplicates(new, stored=None, settle=False, filed=None):
    """Set `is_likely_duplicate` and add the flag for invoices that repeat an earlier one.

    Invoices the classifier already called duplicates are left as they are. The arguments are those
    of `mark_duplicates`.
    """
    marked = mark_duplicates(new, stored, settle, filed)
    hit = F.col("has_earlier_match") & ~F.coalesce("is_likely_duplicate", F.lit(False))
    flags = F.coalesce("anomaly_flags", F.array().cast("array<string>"))
    known = F.coalesce(F.array_contains(flags, POTENTIAL_DUPLICATE), F.lit(False))
    return marked.withColumns(
        {
            "is_likely_duplicate": F.when(hit, F.lit(True)).otherwise(F.col("is_likely_duplicate")),
            "anomaly_flags": F.when(
                hit & ~known, F.array_append(flags, F.lit(POTENTIAL_DUPLICATE))
            ).otherwise(F.col("anomaly_flags")),
        }
    ).drop("has_earlier_match")


def duplicate_matches(new, stored=None, limit=5, settle=False):
    """The earlier invoices each invoice repeats, at most `limit` of them, earliest first.

    The earliest `limit` invoices of a key are enough for every invoice that asks with the key: a
    later one sees them all, one of them sees those before itself.
    """
    shown = F.struct("invoice_number", "total_amount", "invoice_date").alias("_shown")
    filed = _all_filed(new, stored, settle, None, shown)
    # A key with a single invoice matches nobody, so two are needed to tell.
    first = (
        first_n_per_key(filed, GROUP, ["_order", "_shown"], max(limit, 2))
        .groupBy(*GROUP)
        .agg(F.sort_array(F.collect_list(F.struct("_order", "_shown"))).alias("_first"))
        .filter(F.size("_first") > 1)
    )
    first = settled(first.withColumn("_first", F.slice("_first", 1, limit)), settle, "first-of-key")
    asking = new.select(*_MATCHED, F.lit(1).alias("_arrival"))
    found = join_values(asking, _asked_key(), first, "inner").withColumn(
        "_earlier", F.filter("_first", lambda m: m["_order"] < _order())
    )
    return found.select("id", F.posexplode("_earlier").alias("_pos", "_match")).select(
        "id",
        (F.col("_pos") + 1).alias("match_rank"),
        F.col("_match._order.id").alias("match_id"),
        F.col("_match._shown.invoice_number").alias("invoice_number"),
        F.col("_match._shown.total_amount").alias("total_amount"),
        F.col("_match._shown.invoice_date").alias("invoice_date"),
    )
