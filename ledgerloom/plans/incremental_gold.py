"""The gold tables kept up to date from changes, without rebuilding them.

Beside the invoices' narrow records the job keeps for each gold table the sums that it is made of, as
sorted runs (`sources/runs.py`). A batch of changes looks up the records that the changed ids had, takes
them out of the sums and puts the new ones in. Counts and decimal sums take both; the least and the
largest of a group do not: where a batch takes out a group's least or largest value, the group's is found
anew from the records, and what was known of it before is set aside.

The distinct vendors of a month are counted from the invoices by month and vendor, exactly; whether an
invoice is of high value depends on its vendor's average, which is a sum as well and joined on reading.
"""


from pyspark.sql import functions as F

from ledgerloom.functions.money import exact_money
from ledgerloom.operators.changes import DELETE, change_feed
from ledgerloom.operators.gold import ANOMALY_COLUMNS
from ledgerloom.operators.latest import first_per_key
from ledgerloom.operators.lookup import group_values, join_values
from ledgerloom.operators.medallion import anomaly_count, bronze, with_fiscal_period
from ledgerloom.sources.runs import Manifests, RunTable
from ledgerloom.sources.tables import materialize

_HASH = "_hash"
RECORD = {
    "id": "string", "vendor_name_clean": "string", "spend_category": "string",
    "invoice_date_parsed": "date", "fiscal_year": "int", "fiscal_quarter": "int", "fiscal_month": "int",
    "total_amount": "double", "days_to_due": "int", "is_likely_duplicate": "boolean",
    "anomaly_flags": "array<string>", "anomaly_count": "int",
}
_RECORDS = f"{_HASH} long, " + ", ".join(f"{c} {t}" for c, t in RECORD.items()) + ", gone boolean, seq long"

# Groups of each kept table, and the column whose least and largest it shows.
STATES = {
    "spend_by_category": (["fiscal_year", "fiscal_quarter", "fiscal_month", "spend_category"], "total_amount"),
    "vendor_analysis": (["vendor_name_clean", "spend_category"], "invoice_date_parsed"),
    "vendor_months": (["fiscal_year", "fiscal_month", "vendor_name_clean"], None),
}
_SUMS = ["n", "amounts", "outside_n", "duplicates", "flags", "days", "dated"]


def _state_schema(groups, extreme):
    kind = RECORD[extreme] if extreme else "int"
    named = [f"{c} {RECORD[c]}" for c in groups] + ["total decimal(38,6)", "outside double"]
    named += [f"{c} long" for c in _SUMS] + [f"low {kind}", f"high {kind}", "seq long", "anew boolean"]
    return f"{_HASH} long, " + ", ".join(named)


def _added_up(groups):
    """One row for each group: sums over the runs, and the extremes since they were last found anew.
    A group has a row in a run at most, so what is gathered is bounded by the number of runs."""

    def combine(rows):
        part = F.struct("seq", "anew", "low", "high")
        sums = [F.sum(c).cast("decimal(38,6)" if c == "total" else "long").alias(c) for c in ["total", *_SUMS]]
        summed = rows.groupBy(_HASH, *groups).agg(
            *sums, F.sum("outside").alias("outside"), F.collect_list(part).alias("parts")
        )
        since = F.array_max(F.transform(F.filter("parts", lambda p: p["anew"]), lambda p: p["seq"]))
        summed = summed.withColumn("since", since)
        valid = F.filter("parts", lambda p: F.col("since").isNull() | (p["seq"] >= F.col("since")))
        return summed.select(
            _HASH, *groups, "total", "outside", *_SUMS,
            F.array_min(F.transform(valid, lambda p: p["low"])).alias("low"),
            F.array_max(F.transform(valid, lambda p: p["high"])).alias("high"),
            F.coalesce("since", F.array_max(F.transform("parts", lambda p: p["seq"]))).alias("seq"),
            F.col("since").isNotNull().alias("anew"),
        )

    return combine


def _latest(records):
    return first_per_key(records, [_HASH, "id"], [F.desc("seq")])


def narrow_records(invoices):
    """The records that gold needs, of processed invoices, one for each id."""
    silver = with_fiscal_period(bronze(invoices)).withColumns(
        {
            "anomaly_count": anomaly_count(),
            "days_to_due": F.datediff("due_date_parsed", "invoice_date_parsed"),
        }
    )
    return silver.select([F.col(c).cast(t).alias(c) for c, t in RECORD.items()])


class IncrementalGold:
    """The kept tables below `path`, as they are when opened; `apply` moves them on. One writer."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self._manifests = Manifests(spark, path)
        self._open()

    def _open(self):
        entries = self._manifests.entries()
        self.state = entries[0] if entries else {"seq": 0}
        self.records = self._table("records")
        self.sums = {name: self._table(name) for name in STATES}

    def _table(self, name, newest=False):
        number = None if newest else self.state.get(name, 0)
        if name == "records":
            schema, combine = _RECORDS, _latest
        else:
            schema, combine = _state_schema(*STATES[name]), _added_up(STATES[name][0])
        return RunTable(self.spark, f"{self.path}/{name}", schema, _HASH, combine, number)

    def apply(self, changed, deleted=None, writer="apply", number=None):
        """Put in new and changed invoices (whole records, as in the store; one that is no longer
        processed goes out), and take out the ids in column `id` of `deleted`.

        `writer` and `number` name a batch that may be given again, in place of its first attempt. Reads
        the records of the changed ids and the sums of their groups; all records only where a group's
        least or largest value has gone.
        """
        self._open()
        seq = self.state["seq"] + 1
        own = (writer, seq if number is None else number)
        ids = changed.select(F.col("id").cast("string").alias("id"))
        if deleted is not None:
            ids = ids.unionByName(deleted.select(F.col("id").cast("string").alias("id")))
        ids = materialize(ids.dropna().distinct().withColumn(_HASH, F.xxhash64("id")), "gold-ids")
        new = narrow_records(changed).filter("id is not null")
        if deleted is not None:
            new = new.join(deleted.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_anti")
        new = materialize(new, "gold-new")
        old = self.records.find(ids, own).join(ids.select("id"), "id", "left_semi")
        old = materialize(_latest(old).filter(~F.col("gone")).select(*RECORD), "gold-old")
        rows = ids.join(new.withColumn("gone", F.lit(False)), "id", "left").select(
            _HASH, *RECORD, F.coalesce("gone", F.lit(True)).alias("gone"), F.lit(seq).cast("long").alias("seq")
        )
        records = self._table("records", newest=True)
        records.put(rows, *own)
        images = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        state = {"seq": seq, "records": records.last()}
        for name, (groups, extreme) in STATES.items():
            delta = materialize(_delta(images, groups, extreme, seq), f"gold-{name}")
            if extreme:
                delta = self._with_extremes(delta, name, groups, extreme, records, own)
            table = self._table(name, newest=True)
            table.put(delta, *own)
            state[name] = table.last()
        self._manifests.commit(lambda entries: [state])
        self._open()

    def _with_extremes(self, delta, name, groups, extreme, records, own):
        """Find a group's least and largest anew where the batch may have taken one of them out."""
        known = _added_up(groups)(self.sums[name].find(delta, own)).select(
            *groups, F.col("low").alias("was_low"), F.col("high").alias("was_high")
        )
        key = F.struct(*groups)
        known = group_values(known, groups, was_low=F.min("was_low"), was_high=F.max("was_high"))
        delta = join_values(delta, key, known)
        # A value as far out that comes in takes the place of the one that goes.
        lost = [
            (F.col("out_low") <= F.col("was_low")) & ~F.coalesce(F.col("low") <= F.col("out_low"), F.lit(False)),
            (F.col("out_high") >= F.col("was_high")) & ~F.coalesce(F.col("high") >= F.col("out_high"), F.lit(False)),
        ]
        lost = F.coalesce(lost[0], F.lit(False)) | F.coalesce(lost[1], F.lit(False))
        delta = materialize(delta.withColumn("lost", lost), f"gold-{name}-lost")
        asked = delta.filter("lost").select(*groups)
        if not asked.isEmpty():
            wanted = group_values(asked, groups, found=F.count(F.lit(1)))
            rows = _latest(records.rows()).filter(~F.col("gone"))
            rows = join_values(rows, key, wanted, "left_semi")
            found = group_values(rows, groups, now_low=F.min(extreme), now_high=F.max(extreme))
            delta = join_values(delta, key, found)
            for c in ("low", "high"):
                delta = delta.withColumn(c, F.when(F.col("lost"), F.col(f"now_{c}")).otherwise(F.col(c)))
        return delta.withColumn("anew", F.col("lost"))

    # The gold tables ----------------------------------------------------------------------------------

    def _sums_of(self, name):
        groups, _ = STATES[name]
        rows = _added_up(groups)(self.sums[name].rows()).filter("n > 0")
        total = F.when(F.col("amounts") > 0, F.coalesce(F.col("total"), F.lit(0)).cast("double"))
        outside = F.when(F.col("outside_n") > 0, F.col("outside"))
        total = F.when(outside.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + outside)
        count = F.col("amounts") + F.col("outside_n")
        return rows.withColumns({"total_spend": total, "average": F.try_divide(total, count)})

    def spend_by_category(self):
        """As `gold.spend_by_category`."""
        return self._sums_of("spend_by_category").select(
            *STATES["spend_by_category"][0], F.col("n").alias("invoice_count"), "total_spend",
            F.col("average").alias("avg_invoice_amount"), F.col("low").alias("min_invoice_amount"),
            F.col("high").alias("max_invoice_amount"), F.col("duplicates").alias("duplicate_count"),
            F.col("flags").alias("total_anomaly_flags"),
        )

    def vendor_analysis(self):
        """As `gold.vendor_analysis`."""
        return self._sums_of("vendor_analysis").select(
            *STATES["vendor_analysis"][0], F.col("n").alias("invoice_count"), "total_spend",
            F.col("average").alias("avg_invoice_amount"), F.col("low").alias("first_invoice_date"),
            F.col("high").alias("last_invoice_date"),
            F.try_divide("days", "dated").alias("avg_days_to_due"), F.col("duplicates").alias("duplicate_count"),
        )

    def monthly_trend(self):
        """As `gold.monthly_trend`, with the exact number of vendors."""
        months = self._sums_of("vendor_months").groupBy("fiscal_year", "fiscal_month")
        total, outside = F.sum("total").cast("double"), F.sum(F.when(F.col("outside_n") > 0, F.col("outside")))
        total = F.when(F.sum("amounts") > 0, total)
        return months.agg(
            F.sum("n").alias("invoice_count"),
            F.when(outside.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + outside).alias("total_spend"),
            F.count("vendor_name_clean").alias("unique_vendors"),
            F.sum("flags").alias("total_anomalies"),
        )

    def anomaly_summary(self):
        """As `gold.anomaly_summary`: the flagged records, with their vendors' averages as they are now."""
        vendors = self._sums_of("vendor_months").groupBy("vendor_name_clean")
        total = F.sum(F.coalesce("total_spend", F.lit(0.0)))
        vendors = vendors.agg(F.try_divide(total, F.sum(F.col("amounts") + F.col("outside_n"))).alias("_average"))
        averages = group_values(vendors, ["vendor_name_clean"], _average=F.max("_average"))
        flagged = _latest(self.records.rows()).filter("not gone and anomaly_count > 0")
        rows = join_values(flagged, F.struct("vendor_name_clean"), averages)
        high = F.coalesce(F.col("total_amount") > F.col("_average") * 3, F.lit(False))
        return rows.withColumn("is_high_value", high).select(ANOMALY_COLUMNS)


def _delta(images, groups, extreme, seq):
    """What a batch changes in the groups' sums: rows put in count once, rows taken out count minus one.
    `out_low` and `out_high` are the extremes of the rows taken out."""
    sign, amount = F.col("sign"), F.col("total_amount")
    exact = exact_money("total_amount")
    outside = exact.isNull() & amount.isNotNull()

    def signed(value, alias):
        return F.sum(sign * value).cast("long").alias(alias)

    is_in, is_out = sign > 0, sign < 0
    value = F.col(extreme) if extreme else F.lit(None).cast("int")
    return images.groupBy(*groups).agg(
        F.sum(exact * sign).cast("decimal(38,6)").alias("total"),
        F.sum(F.when(outside, amount * sign)).alias("outside"),
        signed(F.lit(1), "n"),
        signed(exact.isNotNull().cast("int"), "amounts"),
        signed(outside.cast("int"), "outside_n"),
        signed(F.coalesce("is_likely_duplicate", F.lit(False)).cast("int"), "duplicates"),
        signed(F.col("anomaly_count"), "flags"),
        signed(F.coalesce("days_to_due", F.lit(0)), "days"),
        signed(F.col("days_to_due").isNotNull().cast("int"), "dated"),
        F.min(F.when(is_in, value)).alias("low"), F.max(F.when(is_in, value)).alias("high"),
        F.min(F.when(is_out, value)).alias("out_low"), F.max(F.when(is_out, value)).alias("out_high"),
    ).select(F.xxhash64(*groups).alias(_HASH), "*", F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("anew"))


def gold_between(old, new, gold, key="id"):
    """Bring `gold` from one version of the invoice store to another by their change feed."""
    feed = materialize(change_feed(old, new, key, settle=True), "change-feed")
    gone = F.col("_change") == DELETE
    gold.apply(feed.filter(~gone).drop("_change"), feed.filter(gone).select("id"))
    return gold
