"""Shards by jump consistent hashing, with DataFrame functions only.

The shard of a row follows from its key and the number of shards alone: there is no ring table, and
one more shard takes rows only into itself, about `1 / (n + 1)` of them.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch

SHARDS = 24
ROW_OVERHEAD = 8  # bytes that a row takes besides its text
# Fixed values of the jump hash: multiplier of its generator, and the bits it draws.
MULTIPLIER = 2862933555777941757
WORD = Decimal(1 << 64)
DRAWN_BELOW = 33


def jump_shard(key: Column, shards: int) -> Column:
    """Jump consistent hash of a long key, as int from 0 to `shards - 1`; a null key counts as 0.

    The generator's products are taken in decimals, which hold 128 bits, and reduced to 64 bits. Each
    step jumps at least one shard ahead, so `shards` steps always reach the end.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    unsigned = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    word = F.lit(WORD).cast("decimal(20,0)")
    unsigned = F.when(unsigned < 0, unsigned + word).otherwise(unsigned)
    start = F.struct(
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
        unsigned.cast("decimal(20,0)").alias("state"),
    )

    def step(acc, _):
        state = ((acc["state"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % word).cast(
            "decimal(20,0)"
        )
        drawn = F.floor(state / F.lit(1 << DRAWN_BELOW).cast("decimal(11,0)")).cast("double")
        ahead = F.floor((acc["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (drawn + 1.0)))
        moved = F.struct(
            acc["next"].alias("shard"), ahead.cast("long").alias("next"), state.alias("state")
        )
        return F.when(acc["next"] < shards, moved).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda acc: acc["shard"].cast("int"))


def assign_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS
) -> DataFrame:
    """One row for each row of `docs`: id, size, text_crc32, law (`key`), shard, slot, grown_shard.

    `size` is the length of the text in UTF-8 and 8 bytes more, `text_crc32` its unsigned CRC-32; a
    null text counts as empty. Ids that are not whole numbers go by their hash. `grown_shard` is the shard with one shard more. `slot` numbers the rows
    of a shard without gaps from 0, in the order of id (null first), size and checksum; equal rows
    take neighbouring slots. Ids that are null share the key 0. Other columns of `docs` play no part.

    The rows, without their texts, are sorted by ranges once and numbered by their place in a range;
    an id that holds a third of all rows is cut between ranges, as a salt is part of the order.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    whole = docs.select(key).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")
    hashed = key if whole else F.when(key.isNotNull(), F.xxhash64(key))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        jump_shard(hashed, shards).alias("shard"),
        jump_shard(hashed, shards + 1).alias("grown_shard"),
    )
    rows = scratch.store(rows, "rows")
    order = ["shard", "doc_id", "size", "text_crc32", "_salt"]
    ranged = (
        rows.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # The place is the range's number, then the row's number in it.
    ranged = ranged.select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard",
        F.shiftright("_place", 33).alias("_range"),
        F.col("_place").bitwiseAND((1 << 33) - 1).alias("_local"),
    )
    ranged = scratch.store(ranged, "ranged")
    parts = ranged.groupBy("shard", "_range").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_local").alias("first")
    )
    # At most one part more than ranges for each shard, so this table has a bound.
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "shard", "_range", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    )
    return ranged.join(F.broadcast(offsets), ["shard", "_range"]).select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("_local") - F.col("first")).alias("slot"),
        "grown_shard",
    )
