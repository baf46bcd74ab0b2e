"""Removal of byte strings that occur earlier in the corpus, by suffix arrays over shards.

A string of `length` bytes is redundant if it starts earlier too: in a document of smaller id, or
before in the same one. All bytes that redundant strings cover are removed.

1. Anchors. Every string has an anchor, the smallest hash among its short substrings. Neighbouring
   strings with the same anchor form a block, on average some forty strings. Equal strings have equal
   anchors wherever they are, so only blocks with one anchor can hold equal strings.
2. The blocks (an anchor, a hash of the block's bytes, a place) are shuffled by anchor. An equal block
   that starts earlier makes a whole block redundant. Blocks that share the anchor and differ, and
   blocks in which the anchor repeats, must be looked into: their bytes are fetched from the texts.
3. The fetched blocks are shuffled by anchor into shards, and each shard gets its suffix array
   (Larsson-Sadakane) and common prefixes (Kasai). Suffixes with `length` bytes in common are equal
   strings; all but the earliest are redundant. A shard is cut at a size, and the strings of an anchor
   that goes on in the next shard are merged by binary search in the sorted strings before.
4. The redundant stretches go to their documents, where they are united and cut out.

Anchors of very many different blocks (a common line in ever new company) are spread by the hash of
each string instead, so no shard gathers them.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, small_batches
from ledgerloom.llm.suffix_array import equal_classes
from ledgerloom.operators.lookup import with_group_values

LENGTH = 100
GRAM = 24
HOT_BLOCKS = 4096  # different blocks of one anchor, beyond which its strings are spread
SHARD_BYTES = 2 << 20
_SLAB = 4 << 20  # bytes of texts that are cut into blocks together
_LOWEST = -(1 << 63)  # stands for a null id: before all others
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

# A block: anchor, hash of its bytes, document (id and a tie), first string, number of strings.
BLOCK = "key long, digest long, doc long, tie long, first int, count int, repeats boolean"


def _gram_hashes(data):
    """A hash of every `GRAM` bytes."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    h = words[:n] * _A
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n] * _B
    h ^= h >> np.uint64(32)
    h *= _C
    h += words[16 : 16 + n] * _A
    h ^= h >> np.uint64(31)
    h *= _B
    h ^= h >> np.uint64(30)
    return h


def _sliding(values, width, least):
    """The least (or most) of every `width` neighbours."""
    size, n = 1, len(values) - width + 1
    while 2 * size <= width:
        values = least(values[:-size], values[size:])
        size *= 2
    return least(values[:n], values[width - size : width - size + n])


def blocks_of(data: bytes, length: int = LENGTH):
    """(anchors, first strings, numbers of strings, whether the anchor repeats) of one text."""
    width = length - GRAM + 1
    hashes = _gram_hashes(np.frombuffer(data, np.uint8))
    anchor = _sliding(hashes, width, np.minimum)
    first = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
    count = np.diff(first, append=len(anchor))
    # A gram is chosen if it is the smallest of some string that it is in: then it equals the largest
    # anchor of those strings. Blocks, in their order, are the runs of chosen grams of equal hash.
    edge = np.zeros(width - 1, np.uint64)
    chosen = hashes[hashes == _sliding(np.concatenate([edge, anchor, edge]), width, np.maximum)]
    runs = np.append(0, np.flatnonzero(chosen[1:] != chosen[:-1]) + 1)
    repeats = np.diff(runs, append=len(chosen)) > 1
    return anchor[first].view(np.int64), first, count, repeats


def _blocks(data, length):
    """The same, for a text of any length: a long one is cut in stretches."""
    parts = []
    for at in range(0, len(data) - length + 1, _SLAB):
        key, first, count, repeats = blocks_of(data[at : at + _SLAB + length - 1], length)
        parts.append((key, first + at, count, repeats))
    return [np.concatenate(x) for x in zip(*parts)]


def _cut(batches, length):
    """The blocks of the texts. Among equal blocks of one slab only the earliest is sent by its
    anchor; the others are redundant already and travel by a key of their own document."""
    held, size = [], 0

    def rows():
        parts, digests = [], []
        for doc, tie, data in held:
            key, first, count, repeats = _blocks(data, length)
            view = memoryview(data)
            ends = first + count + (length - 1)
            digests += [
                xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), ends.tolist())
            ]
            n = len(first)
            parts.append((key, np.full(n, doc), np.full(n, tie), first, count, repeats))
        key, doc, tie, first, count, repeats = (np.concatenate(x) for x in zip(*parts))
        digest = np.array(digests, np.uint64).view(np.int64)
        order = np.lexsort((first, tie, doc, digest, key))
        key, digest, doc, tie, first, count, repeats = (
            x[order] for x in (key, digest, doc, tie, first, count, repeats)
        )
        known = np.zeros(len(key), bool)
        known[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
        key = np.where(known, (doc.view(np.uint64) * _A + first.astype(np.uint64)).view(np.int64), key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key),
                pa.array(digest, mask=known),
                pa.array(doc),
                pa.array(tie),
                pa.array(first.astype(np.int32)),
                pa.array(count.astype(np.int32)),
                pa.array(repeats),
            ],
            ["key", "digest", "doc", "tie", "first", "count", "repeats"],
        )

    for batch in batches:
        columns = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
        for doc, tie, text in columns:
            data = text.as_py()
            if data is None or len(data) < length:
                continue
            held.append((doc, tie, data))
            size += len(data)
            if size >= _SLAB:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def _judge(batches):
    """Redundant blocks, and blocks to look into (`anchor` is set), of a partition sorted by key,
    digest and place. Rows without a digest are redundant already."""
    # Of the key that was read last: its digest, whether another digest came before, and its first
    # block as long as it is not known whether there is another one.
    last_key = last_digest = waiting = None
    several = False
    names = ["doc", "tie", "first", "count", "anchor"]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        known = table["digest"].is_null().to_numpy()
        key, doc, tie = (table[c].to_numpy() for c in ("key", "doc", "tie"))
        first, count = table["first"].to_numpy(), table["count"].to_numpy()
        repeats = table["repeats"].to_numpy()
        digest = table["digest"].fill_null(0).to_numpy()
        place = np.flatnonzero(~known)
        redundant = known.copy()
        look = np.zeros(len(key), bool)
        extra = []
        if len(place):
            k, d = key[place], digest[place]
            new_key = np.ones(len(k), bool)
            new_key[1:] = k[1:] != k[:-1]
            new_key[0] = last_key is None or k[0] != last_key
            new_digest = new_key.copy()
            new_digest[1:] |= d[1:] != d[:-1]
            if not new_key[0]:
                new_digest[0] = d[0] != last_digest
            redundant[place[~new_digest]] = True
            run = np.cumsum(new_key)  # 0: the key of the batch before goes on
            heads = np.bincount(run, weights=new_digest, minlength=run[-1] + 1).astype(np.int64)
            if not new_key[0] and heads[0] and not several:
                several = True
                if waiting is not None:
                    extra.append(waiting)
                    waiting = None
            many = heads > 1
            many[0] = several and not new_key[0]
            look_at = new_digest & (many[run] | repeats[place])
            look[place[look_at]] = True
            if run[-1] > 0:
                several = bool(many[run[-1]])
                waiting = None
                if not several:
                    head = place[np.flatnonzero(new_digest & (run == run[-1]))[0]]
                    if not look[head]:
                        waiting = (doc[head], tie[head], first[head], count[head], key[head])
            last_key, last_digest = k[-1], d[-1]
        out = redundant | look
        anchor = pa.array(key[out], mask=~look[out])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[out]), pa.array(tie[out]), pa.array(first[out]), pa.array(count[out]), anchor],
            names,
        )
        if extra:
            columns = [np.array(c) for c in zip(*extra)]
            types = [np.int64, np.int64, np.int32, np.int32, np.int64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(t)) for c, t in zip(columns, types)], names
            )


def _fetch(length, hot):
    """UDF: the bytes of the asked blocks of a text; of hot anchors, the hash of each string."""

    @F.arrow_udf(
        "array<struct<anchor: bigint, other: bigint, first: int, count: int, bytes: binary>>"
    )
    def of(texts: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for text, blocks in zip(texts, asked.to_pylist()):
            data, found = text.as_py(), []
            for block in blocks:
                first, count = block["first"], block["count"]
                if not hot:
                    end = first + count + length - 1
                    found.append((block["anchor"], None, first, count, data[first:end]))
                    continue
                for i in range(first, first + count):
                    value = xxhash.xxh3_128_intdigest(data[i : i + length])
                    halves = (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)
                    found.append((*halves, i, 1, None))
            out.append(found)
        names = ["anchor", "other", "first", "count", "bytes"]
        kind = pa.struct(
            zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])
        )
        return pa.array([[dict(zip(names, f)) for f in found] for found in out], pa.list_(kind))

    return of


class _Open:
    """The sorted strings of an anchor that goes on in the next shard, with their earliest place."""

    def __init__(self):
        self.key, self.strings, self.place = None, None, None


def _shard(rows, open_, last_key, length):
    """Redundant strings of one shard, merged with what is open from the shards before.

    `rows` are (key, doc, tie, first, count, bytes). Returns arrays doc, tie, first, count.
    """
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    size = np.array([len(r[5]) for r in rows])
    start = np.cumsum(size) - size
    strings = np.array([r[4] for r in rows])
    row_of = np.repeat(np.arange(len(rows)), strings)
    nth = np.arange(len(row_of)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = start[row_of] + nth  # where each string begins in the shard
    doc, tie, first = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    key = np.array([r[0] for r in rows], np.int64)
    age_order = np.lexsort((first[row_of] + nth, tie[row_of], doc[row_of]))
    age = np.empty(len(at), np.int64)
    age[age_order] = np.arange(len(at))
    order, number = equal_classes(data, length)
    class_of = np.empty(len(data), np.int64)
    class_of[order] = number
    kind = class_of[at]
    by = np.lexsort((age, kind))
    earliest = np.zeros(len(at), bool)
    earliest[by] = np.append(True, kind[by][1:] != kind[by][:-1])
    redundant = ~earliest

    def window(chosen):
        every = np.ndarray((len(data) - length + 1,), f"S{length}", data, strides=(1,))
        return every[at[chosen]]

    place = list(zip(doc[row_of].tolist(), tie[row_of].tolist(), (first[row_of] + nth).tolist()))
    late = []
    if open_.key is not None:
        mine = np.flatnonzero(earliest & (key[row_of] == open_.key))
        if len(mine):
            found = np.searchsorted(open_.strings, window(mine))
            found = np.minimum(found, len(open_.strings) - 1)
            same = open_.strings[found] == window(mine)
            for i, j in zip(mine[same].tolist(), found[same].tolist()):
                if place[i] > open_.place[j]:
                    redundant[i] = True
                else:  # the one of the shard before is the later one
                    late.append((*open_.place[j], 1))
                    open_.place[j] = place[i]
    if last_key is None:
        open_.key = None
    else:
        mine = np.flatnonzero(earliest & ~redundant & (key[row_of] == last_key))
        fresh, where = window(mine), [place[i] for i in mine.tolist()]
        if open_.key == last_key:
            fresh, where = np.concatenate([open_.strings, fresh]), open_.place + where
        by = np.argsort(fresh, kind="stable")
        open_.key, open_.strings, open_.place = last_key, fresh[by], [where[i] for i in by.tolist()]
    # Neighbouring redundant strings of a block as one stretch.
    hit = np.flatnonzero(redundant)
    begin = np.ones(len(hit), bool)
    begin[1:] = (np.diff(hit) != 1) | (np.diff(row_of[hit]) != 0)
    head = hit[begin]
    count = np.diff(np.flatnonzero(begin), append=len(hit))
    out = [doc[row_of[head]], tie[row_of[head]], first[row_of[head]] + nth[head], count]
    if late:
        out = [np.concatenate([o, c]) for o, c in zip(out, np.array(late, np.int64).T)]
    return out


def _match(batches, length, shard_bytes):
    """Redundant strings of a partition of fetched blocks, sorted by anchor."""
    open_, held, size = _Open(), [], 0

    def result(last_key):
        doc, tie, first, count = _shard(held, open_, last_key, length)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(tie), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
            ["doc", "tie", "first", "count"],
        )

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if size >= shard_bytes:
                yield result(held[-1][0] if held[-1][0] == row[0] else None)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield result(None)


def _remover(length):
    """UDF: what is left of a text, and the removed stretches."""

    @F.arrow_udf("struct<kept: binary, spans: array<struct<begin: bigint, `end`: bigint>>>")
    def of(texts: pa.Array, stretches: pa.Array) -> pa.Array:
        kept, spans = [], []
        for text, found in zip(texts, stretches.to_pylist()):
            data = text.as_py() or b""
            merged = []
            for begin, end in sorted((f["first"], f["first"] + f["count"] + length - 1) for f in found or ()):
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
            at, left = 0, []
            for begin, end in merged:
                left.append(data[at:begin])
                at = end
            kept.append(b"".join([*left, data[at:]]) if merged else data)
            spans.append([{"begin": b, "end": e} for b, e in merged])
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["kept", "spans"]
        )

    return of


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    hot_blocks: int = HOT_BLOCKS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row for each row of `docs`: id, text (UTF-8 bytes), kept (what is left of them) and spans
    (the removed stretches, begin to end).

    Texts shorter than `length` keep all their bytes; null texts count as empty. A null id comes before
    all others. Rows with equal ids are taken in the order of a hash of their text; rows that are equal
    in id and text are one document, and each of them gets its result. Other columns play no part.
    Ids are numbers. `length` must be at least 40.
    """
    if length < GRAM + 16:
        raise ValueError(f"length must be at least {GRAM + 16}")
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    given = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc"),
        F.col(text_col).cast("binary").alias("text"),
    )
    # The order among equal ids costs 8 bytes a block, so it is carried only where ids repeat.
    repeated = given.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    keys = ["doc", "tie"] if repeated else ["doc"]
    texts = given.select("doc", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("tie"), "text")
    once = texts.dropDuplicates(keys) if repeated else texts
    calls = (
        once.mapInArrow(partial(_cut, length=length), BLOCK)
        .repartition("key")
        .sortWithinPartitions("key", "digest", "doc", "tie", "first")
        .mapInArrow(_judge, "doc long, tie long, first int, count int, anchor long")
    )
    calls = scratch.store(calls, "calls")
    looked = calls.filter("anchor IS NOT NULL")
    hot = looked.groupBy("anchor").count().filter(F.col("count") > hot_blocks).select("anchor")
    hot = scratch.store(hot, "hot")

    def fetch(blocks, hot):
        """The bytes (of hot anchors, the strings' hashes) of some blocks, from their texts."""
        asked = blocks.groupBy(keys).agg(
            F.collect_list(F.struct("anchor", "first", "count")).alias("asked")
        )  # a list is bounded by the length of its document
        return once.join(asked, keys).select(
            "doc", "tie", F.explode(_fetch(length, hot)("text", "asked")).alias("f")
        ).select("doc", "tie", "f.*")

    columns = ["doc", "tie", "first", "count"]
    some_hot = hot.limit(1).count()
    cold = looked.join(hot, "anchor", "left_anti") if some_hot else looked
    stretches = calls.filter("anchor IS NULL").select(columns).unionByName(
        fetch(cold, False)
        .select("anchor", "doc", "tie", "first", "count", "bytes")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(
            partial(_match, length=length, shard_bytes=shard_bytes),
            "doc long, tie long, first int, count int",
        )
    )
    if some_hot:
        strings = with_group_values(
            fetch(looked.join(hot, "anchor", "left_semi"), True),
            ["anchor", "other"],
            earliest=F.min(F.struct("doc", "tie", "first")),
        )
        later = strings.filter(F.struct("doc", "tie", "first") > F.col("earliest"))
        stretches = stretches.unionByName(later.select(columns))
    stretches = stretches.groupBy(keys).agg(
        F.collect_list(F.struct("first", "count")).alias("stretches")
    )
    joined = texts.join(stretches, keys, "left")
    return joined.withColumn("_left", _remover(length)("text", "stretches")).select(
        F.when(F.col("doc") != _LOWEST, F.col("doc")).alias(id_col),
        F.coalesce("text", F.lit(b"")).alias("text"),
        "_left.kept",
        "_left.spans",
    )
