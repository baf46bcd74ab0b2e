"""Joining rows to per-key values when one key may hold a large part of all rows.

A window over the key would put a hot key's rows into one task. Here the per-key values come from a
partially aggregated `groupBy`, and the rows are joined to them. Three details keep that even and
cheap:

* The key is a struct, so null keys meet null keys by plain equality.
* A hash of the key goes before it in groupings and joins. Rows then sort by a number, and structs
  are compared only where it ties.
* The join has one column more than the grouping. Values grouped by the same columns are already
  partitioned for the join, and Spark would join them without an exchange; the skew rule of adaptive
  execution only splits partitions it reads straight from an exchange. With the extra column Spark
  plans its own exchange on both sides, so a hot partition of the rows is split over many tasks (or
  the small side is broadcast at run time, once its measured size allows it).
"""

from pyspark.sql import functions as F

from ledgerloom.sources.tables import settled

BROADCAST_BYTES = 32 << 20  # of a narrow written side that goes out whole, whatever Spark's own limit
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
KEY = "_lookup_key"
HASH = "_lookup_hash"
GROUP = [HASH, KEY]
_SPLIT = "_lookup_split"


def keyed(rows, key):
    """Add the columns of `GROUP` for a struct column over the rows."""
    return rows.withColumn(KEY, key).withColumn(HASH, F.xxhash64(KEY))


def join_keyed(rows, values, how="left"):
    """Join rows that have the columns of `GROUP` to a table with one row per key.

    `values` holds the columns of `GROUP`, unique, and any number of value columns.
    """
    split = F.pmod(HASH, F.lit(1024))
    left, right = rows.withColumn(_SPLIT, split), values.withColumn(_SPLIT, split)
    return left.join(right, [*GROUP, _SPLIT], how).drop(_SPLIT)


def join_values(rows, key, values, how="left"):
    """The same for rows without these columns; `key` is a struct column over them."""
    return join_keyed(keyed(rows, key), values, how).drop(*GROUP)


def group_values(rows, keys, **aggregates):
    """The aggregates per key, as `join_values` takes them."""
    aggregates = [agg.alias(name) for name, agg in aggregates.items()]
    return keyed(rows, F.struct(*keys)).groupBy(*GROUP).agg(*aggregates)


def sent_out(values, size=None):
    """The settled side of a join, to be broadcast where what was written of it takes at most
    `BROADCAST_BYTES`: the other side has whole rows, which would all move otherwise. Where broadcasts
    are turned off it is left to Spark."""
    if size is None:
        size = int(str(values._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    off = values.sparkSession.conf.get(BROADCAST).startswith("-")
    return values if off or size > BROADCAST_BYTES else F.broadcast(values)


def with_group_values(rows, keys, settle=False, **aggregates):
    """Add aggregates over all rows with the same key to every row.

    Left lazy, the join disappears when nobody uses the added columns, but Spark moves all rows
    before it knows how many keys there are. With `settle` the per-key values are written to the
    shared folder first and the join is planned from their real size: unless there are very many keys
    they are broadcast (`sent_out`) and the rows stay where they are.
    """
    values = settled(group_values(rows, keys, **aggregates), settle, "group-values")
    values = sent_out(values) if settle else values
    return join_values(rows, F.struct(*keys), values)
