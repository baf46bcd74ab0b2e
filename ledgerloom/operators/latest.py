"""Keeping one row per key under a total order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import GROUP, group_values, join_values, sent_out
from ledgerloom.sources.tables import settled


def row_hash(df, exclude=()):
    """Hash over all columns, the last tie-break between rows of one key."""
    return F.xxhash64(*[F.col(c) for c in df.columns if c not in exclude])


def first_per_key(df, keys, order):
    """The first row of each key.

    `row_number() = 1` lets Spark drop all but one row of a key in every map task before the
    shuffle, so a key with very many copies costs one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def first_n_per_key(df, keys, order, n):
    """The first `n` rows of each key, with their rank from 1 in `rank`."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def first_per_repeated_key(df, keys, order, settle):
    """The same as `first_per_key`, for stored tables in which few keys have several rows.

    Keys with several rows are found from the key columns alone and written (`settle`). Only rows of
    these keys move; all others pass straight through as long as the written keys are small enough to
    broadcast (`sent_out`), and meet them in a sort-merge join otherwise.
    """
    repeated = group_values(df, keys, _n=F.count(F.lit(1))).filter("_n > 1").select(*GROUP)
    repeated = settled(repeated, settle, "repeated-keys")
    repeated = sent_out(repeated) if settle else repeated
    key = F.struct(*keys)
    copies = first_per_key(join_values(df, key, repeated, "left_semi"), keys, order)
    return join_values(df, key, repeated, "left_anti").unionByName(copies)
