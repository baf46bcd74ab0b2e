"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at most `2t` bits apart have a common variant within `t` bits of both. So every
distinct fingerprint emits its ball of radius `t`, equal variants meet in a shuffle, and all that meet
are linked. For an odd distance `2t + 1` one differing bit is set aside: the 64 bits are cut into
blocks, each block is masked in turn, and the ball is built on the other bits. Of two fingerprints
that meet, the masked blocks are compared exactly. With a distance of 3 and three blocks that is 131
variants for each fingerprint instead of the 2,081 of a ball of radius 2.

Documents are collapsed to distinct fingerprints first, so a group of copies costs one fingerprint.
Fingerprints that meet are never paired with each other: those with an equal masked block form a star,
and blocks that differ in one bit are found by looking their neighbours up.
"""

from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.scratch import Scratch, small_batches
from ledgerloom.operators.lookup import HASH, KEY, join_keyed, join_values, keyed

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
BLOCKS = 3
HASH_SEED = 42
_FEW = 16  # fingerprints in a run that are compared one by one
_SLICE = 1 << 16  # shingles whose bits are counted at once
_ROWS = 1 << 18  # variants that are compared at once


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """SimHash of one text in UTF-8, as a signed 64-bit integer.

    A to Z are lower-cased, words are cut at ASCII white space. A text shorter than a shingle is one
    shingle; a text without words (or null) has the fingerprint zero.
    """
    words = text.lower().split() if text else ()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        octets = hashes[i : i + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(text, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED):
    """A column of SimHash fingerprints of a text column."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(
            (fingerprint(t.as_py(), shingle_words, seed) for t in texts), pa.int64()
        )

    return of(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def _signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def _plan(max_distance, blocks):
    """For each block to mask, or once for none: the bits kept, and the bits that variants flip."""
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance must be 0 to 3")
    if not 3 <= blocks <= 8:
        raise ValueError("blocks must be 3 to 8")
    radius, odd = divmod(max_distance, 2)
    balls = []
    for low, high in _bounds(blocks) if odd else [(0, 0)]:
        block = ((1 << (high - low)) - 1) << low
        free = [i for i in range(64) if not block >> i & 1]
        flips = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(free, r)]
        balls.append((_signed(((1 << 64) - 1) ^ block), [_signed(x) for x in flips]))
    return balls


def _bounds(blocks):
    """The first bit of each block and the one behind it."""
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def _variants(prints, max_distance, blocks):
    def ball(block, keep, flips):
        masked = F.col("fp").bitwiseAND(F.lit(keep).cast("long"))
        flips = F.array(*[F.lit(x).cast("long") for x in flips])
        return prints.select(
            F.explode(F.transform(flips, lambda x: masked.bitwiseXOR(x))).alias("variant"),
            F.lit(block).cast("byte").alias("block"),
            "fp",
        )

    balls = [ball(i, *one) for i, one in enumerate(_plan(max_distance, blocks))]
    return reduce(DataFrame.unionByName, balls)


def _search(values, wanted):
    """Index of each wanted value in the sorted values, and whether it is there."""
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def _links(variant, block, fp, max_distance, blocks):
    """Links among fingerprints that meet; the three arrays are sorted by block and variant."""
    none = np.empty(0, np.int64)
    if len(fp) < 2:
        return none, none
    change = np.flatnonzero((np.diff(variant) != 0) | (np.diff(block) != 0)) + 1
    run = np.zeros(len(fp), np.int64)
    run[change] = 1
    run = np.cumsum(run)
    several = np.bincount(run)[run] > 1
    variant, block, fp, run = variant[several], block[several], fp[several], run[several]
    if not len(fp):
        return none, none
    odd = max_distance % 2
    low, high = np.array(_bounds(blocks) if odd else [(0, 0)], np.uint64).T
    width = int((high - low).max())
    shift = low[block]
    ones = (np.uint64(1) << (high - low)[block]) - np.uint64(1)
    cut = ((fp.view(np.uint64) >> shift) & ones).astype(np.int64)
    key = (run << width) | cut
    order = np.lexsort((fp, key))
    key, fp, variant, run = key[order], fp[order], variant[order], run[order]
    shift, ones = shift[order], ones[order]
    first = np.ones(len(fp), bool)
    first[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    a, b = [fp[~first]], [fp[head[~first]]]
    heads, head_fp = key[first], fp[first]
    for i in range(width):
        at, found = _search(heads, heads ^ (1 << i))
        found &= heads < heads ^ (1 << i)
        a.append(head_fp[found])
        b.append(head_fp[at[found]])
    if max_distance == 3:
        # All three bits in the masked block: the other bits are equal, so both are their own variant.
        same = (variant.view(np.uint64) ^ fp.view(np.uint64)) & ~(ones << shift) == 0
        own, own_fp, own_run = key[same], fp[same], run[same]
        size = np.bincount(own_run)[own_run] if len(own) else own
        few = size <= _FEW
        for lag in range(1, _FEW):
            pair = np.flatnonzero((own_run[lag:] == own_run[:-lag]) & few[lag:])
            a.append(own_fp[pair])
            b.append(own_fp[pair + lag])
        own, own_fp = own[~few], own_fp[~few]
        if len(own):
            for bits in combinations(range(width), 3):
                other = own ^ sum(1 << i for i in bits)
                at, found = _search(own, other)
                found &= own < other
                a.append(own_fp[found])
                b.append(own_fp[at[found]])
    a, b = np.concatenate(a), np.concatenate(b)
    close = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_distance
    return a[close], b[close]


def _meet(batches, max_distance, blocks):
    """Links of a partition that is sorted by block and variant."""
    held, rows = [], 0

    def linked(parts, last):
        variant, block, fp = (np.concatenate(x) for x in zip(*parts))
        cut = len(fp)
        if not last:  # the last run may go on in the next batch
            new = np.flatnonzero((variant[1:] != variant[:-1]) | (block[1:] != block[:-1]))
            cut = new[-1] + 1 if len(new) else 0
        a, b = _links(variant[:cut], block[:cut], fp[:cut], max_distance, blocks)
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), (
            variant[cut:],
            block[cut:],
            fp[cut:],
        )

    for batch in batches:
        held.append([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
        rows += batch.num_rows
        if rows >= _ROWS:
            out, rest = linked(held, False)
            held, rows = [rest], 0
            yield out
    if held:
        yield linked(held, True)[0]


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` at most `max_distance` bits apart.

    Not every close pair is listed, but any two close fingerprints are joined by a path of links, and
    every link is a verified pair. More blocks make rarer accidental meetings and more variants.

    A fingerprint of 8 bytes becomes some hundred rows, so the fingerprints are dealt out evenly first:
    partitions cut by their present size would be far too large afterwards.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        _variants(prints.repartition(parts), max_distance, blocks)
        .repartition("variant", "block")
        .sortWithinPartitions("block", "variant")
        .select("variant", "block", "fp")
        .mapInArrow(partial(_meet, max_distance=max_distance, blocks=blocks), "a long, b long")
        .distinct()
    )


def _components(docs, id_col, text_col, shingle_words, max_distance, blocks, scratch):
    """(rows, named): doc_id, text_hash and fp of every row of `docs`, and the component of every
    fingerprint, named by one of its fingerprints. Both are written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        fingerprints(text_col, shingle_words).alias("fp"),
    )
    rows = scratch.store(rows, "fingerprints")
    prints = rows.select("fp").distinct()
    components = connected_components(links(prints, max_distance, blocks), scratch)
    named = prints.join(components.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component")
    )
    return rows, scratch.store(named, "components")


def _with_component(rows, named):
    """A fingerprint that very many rows have is split over many tasks."""
    return join_values(rows, F.struct("fp"), named.select(*_keyed("fp"), "component"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row (id, fingerprint, component_id) for each row of `docs`.

    `component_id` is the smallest id among all rows that can be reached over fingerprints at most
    `max_distance` bits apart, the row's own included. Null and blank texts have the fingerprint zero
    and are linked like any other. Repeated rows stay; null ids count for no component's smallest id,
    and a component of null ids only has the id null. Other columns of `docs` play no part.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, named = _components(docs, id_col, text_col, shingle_words, max_distance, blocks, scratch)
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    named = named.join(smallest, "fp")
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = scratch.store(named.join(ids, "component").select("fp", "component_id"), "names")
    joined = join_values(rows, F.struct("fp"), named.select(*_keyed("fp"), "component_id"))
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _keyed(*columns):
    """The grouping columns that `join_values` expects, for a table with one row per key."""
    key = F.struct(*columns)
    return F.xxhash64(key).alias(HASH), key.alias(KEY)


def keep_representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    blocks: int = BLOCKS,
) -> DataFrame:
    """The rows of `docs`, with their own columns, that stand for their near-duplicates: one of each
    component, that with the smallest id, null last; of rows with that id the one with the smallest
    hash of its text, and of rows equal in both any one."""
    scratch = Scratch(docs.sparkSession, "simhash-kept")
    rows, named = _components(docs, id_col, text_col, shingle_words, max_distance, blocks, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = _with_component(rows, named).groupBy("component").agg(F.min(order).alias("first"))
    kept = kept.select("first.doc_id", "first.text_hash")
    kept = scratch.store(kept.select(*_keyed("doc_id", "text_hash")).distinct(), "kept")
    key = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    left = keyed(docs, key)
    found = join_keyed(left, kept, "left_semi")
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.limit(1).count():
        found = found.dropDuplicates([HASH, KEY])
    return found.drop(HASH, KEY)
