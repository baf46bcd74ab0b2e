"""Ranked lexical search with range-maximum tables over posting lists.

Documents are dealt to tasks as they are read, and a task's documents are cut into segments. In a
segment every query term has a posting list by document, with the impact of each posting, and a sparse
table that gives the largest impact of any stretch of the list in two look-ups. A query then goes
best-first over intervals of documents:

* the bound of an interval is the sum, over the query's terms, of the largest impact within it;
* the interval with the largest bound is split at the document of its largest single impact: that
  document is scored, and the intervals on both sides of it get bounds of their own;
* when no bound reaches the score of the last of the best documents, the segment is done.

The best documents of a task's earlier segments bound the later ones, and each task sends `top`
documents for each query at most.
"""

import math
from collections import Counter
from functools import partial, reduce
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, small_batches
from ledgerloom.operators.latest import first_n_per_key

TOP = 20
ITEM_BYTES = 8 << 20  # of query texts that one pass takes
SEGMENT_POSTINGS = 1 << 18
EXPANDED = 8  # intervals of one query that are split at once
NO_ID = (1 << 63) - 1  # stands for a null id, behind all others

# The weight's and the impact's factors, and the parameters of the length.
SCALE = 1000
SATURATED = 1_000_000_000
SATURATION = 12
LENGTH_PART = 25

# Bytes of terms stay, A-Z become lower case, all other bytes below 128 end a term.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; a null text has none."""
    return text.translate(_TERM_BYTES).split() if text else []


def _postings(batches, vocabulary):
    """For each document with terms: its id, the number of its terms, and of those in the vocabulary
    number and occurrences."""
    numbers = vocabulary.value
    for batch in batches:
        ids, lengths, sizes, found, counts = [], [], [], [], []
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for i, text in zip(batch.column(0).to_pylist(), texts):
            terms = terms_of(text)
            if not terms:
                continue
            occurring = Counter(map(numbers.get, terms))
            occurring.pop(None, None)
            ids.append(i)
            lengths.append(len(terms))
            sizes.append(len(occurring))
            found.extend(occurring.keys())
            counts.extend(occurring.values())
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ],
            names=["doc_id", "n", "terms", "counts"],
        )


class Queries:
    """The queries of one pass: for each its distinct terms and their weights, repeats counted."""

    def __init__(self, texts: list[bytes], weights: dict[int, int], numbers: dict[bytes, int]):
        self.terms, self.weights = [], []
        for text in texts:
            times = Counter(numbers[t] for t in terms_of(text))
            known = [t for t in sorted(times) if weights.get(t, 0) > 0]
            self.terms.append(np.array(known, np.int64))
            self.weights.append(np.array([weights[t] * times[t] for t in known], np.int64))


class Segment:
    """Posting lists with impacts, and their sparse tables.

    An entry holds the impact in its upper half and the place, counted from the end, in its lower one:
    the maximum of two entries is the larger impact, and among equal ones the first.
    """

    def __init__(self, ids, lengths, owner, terms, counts, n_terms, n_docs, all_terms):
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids = ids[order]
        self.width = len(ids) + 1
        keys = terms.astype(np.int64) * self.width + rank[owner]
        by_key = np.argsort(keys, kind="stable")
        self.keys = keys[by_key]
        self.docs = rank[owner][by_key]
        tf = counts[by_key]
        m = 100 - LENGTH_PART + (LENGTH_PART * lengths[owner][by_key] * n_docs) // all_terms
        self.impacts = (SATURATED * tf) // (SCALE * tf + SATURATION * m)
        self.starts = np.searchsorted(self.keys, np.arange(n_terms + 1) * self.width)
        self._build(int(np.diff(self.starts).max(initial=1)))

    def _build(self, longest):
        n = len(self.keys)
        self.n = n
        levels = [(self.impacts << 32) | (0xFFFFFFFF - np.arange(n))]
        while (2 << (len(levels) - 1)) <= longest:
            half, last = 1 << (len(levels) - 1), levels[-1]
            level = last.copy()  # entries near the end reach beyond it and are never asked for
            np.maximum(last[: n - half], last[half:], out=level[: n - half])
            levels.append(level)
        self.table = np.concatenate(levels)

    def largest(self, lo, hi):
        """Impact and place of the maximum of each stretch from lo to before hi; 0 where it is empty."""
        size = np.maximum(hi - lo, 1)
        level = np.frexp(size.astype(np.float64))[1] - 1
        row = level * self.n
        inside = hi > lo
        lo = np.where(inside, lo, 0)
        end = np.where(inside, hi - (1 << level), 0)
        row = np.where(inside, row, 0)
        entry = np.maximum(self.table[row + lo], self.table[row + end])
        return np.where(inside, entry >> 32, 0), 0xFFFFFFFF - (entry & 0xFFFFFFFF)


class _Batch:
    """Intervals of some queries, with the stretch of each query term's list that lies in them."""

    def __init__(self, segment, queries, numbers, lo, hi):
        self.sizes = np.array([len(queries.terms[q]) for q in numbers])
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.weights = np.concatenate([queries.weights[q] for q in numbers])
        self.lo, self.hi = lo, hi
        self.segment = segment

    def bounds(self):
        """For each interval its bound, and the document of its largest single impact."""
        impact, place = self.segment.largest(self.lo, self.hi)
        part = impact * self.weights
        first = self.offsets[:-1]
        best = np.maximum.reduceat(part, first)
        at = np.flatnonzero(part == np.repeat(best, self.sizes))
        at = at[np.searchsorted(at, first)]  # the first term with the largest part
        return np.add.reduceat(part, first), self.segment.docs[place[at]]


def _search_segment(segment, queries, best, top):
    """Bring the best documents of every query up to date with a segment's. `best` holds for each a
    heap of (score, -id), the last of the best first."""
    heaps = {}
    asked = [q for q in range(len(queries.terms)) if len(queries.terms[q])]
    if not asked or not segment.n:
        return
    terms = np.concatenate([queries.terms[q] for q in asked])
    whole = _Batch(segment, queries, asked, segment.starts[terms], segment.starts[terms + 1])
    _push(whole, asked, [0] * len(asked), heaps, best, top, segment)
    while heaps:
        popped, numbers = [], []
        for q in list(heaps):
            for _ in range(EXPANDED):
                if not heaps[q] or not _reaches(heaps[q][0], segment, best[q], top):
                    del heaps[q]
                    break
                popped.append(heappop(heaps[q]))
                numbers.append(q)
        if popped:
            _split(popped, numbers, heaps, segment, queries, best, top)


def _reaches(interval, segment, best, top):
    """Whether a document of the interval may still be among the best: a larger score, or the same
    score and a smaller id."""
    if len(best) < top:
        return True
    bound, first = -interval[0], interval[1]
    score, negative_id = best[0]
    return bound > score or (bound == score and int(segment.ids[first]) < -negative_id)


def _split(popped, numbers, heaps, segment, queries, best, top):
    lo = np.concatenate([i[3] for i in popped])
    hi = np.concatenate([i[4] for i in popped])
    batch = _Batch(segment, queries, numbers, lo, hi)
    terms = np.concatenate([queries.terms[q] for q in numbers])
    split = np.repeat(np.array([i[2] for i in popped]), batch.sizes)
    at = np.searchsorted(segment.keys, terms * segment.width + split)
    there = (at < hi) & (segment.docs[np.minimum(at, segment.n - 1)] == split)
    part = np.where(there, segment.impacts[np.minimum(at, segment.n - 1)] * batch.weights, 0)
    scores = np.add.reduceat(part, batch.offsets[:-1])
    for q, interval, score in zip(numbers, popped, scores.tolist()):
        if score > 0:
            entry = (score, -int(segment.ids[interval[2]]))
            if len(best[q]) < top:
                heappush(best[q], entry)
            elif entry > best[q][0]:
                heapreplace(best[q], entry)
    _push(_Batch(segment, queries, numbers, lo, at), numbers, [i[1] for i in popped], heaps, best, top, segment)
    right = _Batch(segment, queries, numbers, at + there, hi)
    _push(right, numbers, [i[2] + 1 for i in popped], heaps, best, top, segment)


def _push(batch, numbers, firsts, heaps, best, top, segment):
    """Keep the intervals that may hold one of the best documents."""
    bounds, splits = batch.bounds()
    splits = splits.tolist()
    for i, (q, bound) in enumerate(zip(numbers, bounds.tolist())):
        if bound > 0:
            if _reaches((-bound, firsts[i]), segment, best[q], top):
                a, z = batch.offsets[i], batch.offsets[i + 1]
                interval = (-bound, firsts[i], splits[i], batch.lo[a:z].copy(), batch.hi[a:z].copy())
                heappush(heaps.setdefault(q, []), interval)


def _search(batches, shared, top):
    """The best documents of a partition for each query, segment by segment."""
    queries, n_terms, n_docs, all_terms = shared.value
    best = [[] for _ in queries.terms]
    held, postings = [], 0

    def settle():
        ids = np.concatenate([h[0] for h in held])
        lengths = np.concatenate([h[1] for h in held])
        sizes = np.concatenate([h[2] for h in held])
        terms, counts = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        owner = np.repeat(np.arange(len(ids)), sizes)
        segment = Segment(ids, lengths, owner, terms, counts, n_terms, n_docs, all_terms)
        _search_segment(segment, queries, best, top)

    for batch in batches:
        found, counts = batch.column(2), batch.column(3)
        held.append(
            (
                batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(zero_copy_only=False),
                found.value_lengths().to_numpy(zero_copy_only=False),
                found.flatten().to_numpy(zero_copy_only=False),
                counts.flatten().to_numpy(zero_copy_only=False),
            )
        )
        postings += len(held[-1][3])
        if postings >= SEGMENT_POSTINGS:
            settle()
            held, postings = [], 0
    if held:
        settle()
    rows = [(q, None if -i == NO_ID else -i, s) for q, heap in enumerate(best) for s, i in heap]
    kinds = (pa.int32(), pa.int64(), pa.int64())
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else ([], [], []), kinds)]
    yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])


def _in_blocks(items, most_bytes):
    """Lists of queries (id and text) of at most so many bytes of text, or of one query."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > most_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
    if block:
        yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The `top` best documents for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased.
    With N documents that have terms, L terms in them, and df documents with a term, the term weighs
    `floor(1000 ln((2N + 2) / (2 df + 1)))`; a document of n terms that holds it tf times gets, for
    each time the item has it, that weight times `10^9 tf div (1000 tf + 12 m)`, where
    `m = 75 + 25 n N div L`. Equal scores go by ascending id, a null id last; scores of 0 are left out.

    Each row of `docs` is a document, also where ids repeat; ids are whole numbers. Null and empty
    texts have no terms: such documents do not count, such items find nothing. Repeated rows of `items`
    count once. Other columns play no part; an empty table on either side gives an empty result.

    `items` is the stated query set: it is read in blocks of at most `item_bytes`, each of which is one
    pass over the documents. A pass keeps the postings of the block's terms in the shared folder, with
    the documents where they are, and then searches them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if texts.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids must be whole numbers, not {texts.schema['doc_id'].dataType.simpleString()}")
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    asked = asked.filter(F.col("text") != "").distinct().withColumn("text", F.col("text").cast("binary"))
    results = []
    for block in _in_blocks(asked.orderBy("item_id", "text"), item_bytes):
        best = _search_block(spark, texts, [text for _, text in block], top)
        names = [(n, item_id) for n, (item_id, _) in enumerate(block)]
        names = spark.createDataFrame(names, f"query int, item_id {kind}")
        results.append(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, results)


def _search_block(spark, texts, queries, top):
    scratch = Scratch(spark, "search")
    vocabulary = sorted({term for text in queries for term in terms_of(text)})
    numbers = {term: n for n, term in enumerate(vocabulary)}
    postings = texts.mapInArrow(
        partial(_postings, vocabulary=spark.sparkContext.broadcast(numbers)),
        "doc_id long, n long, terms array<int>, counts array<long>",
    )
    postings = scratch.store(postings, "postings")
    figures = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, all_terms = figures["docs"], figures["terms"] or 1
    # One number for each distinct term of the block.
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = {
        row["term"]: math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * row["count"] + 1))) for row in held
    }
    shared = spark.sparkContext.broadcast(
        (Queries(queries, weights, numbers), len(vocabulary), n_docs, all_terms)
    )
    found = postings.mapInArrow(partial(_search, shared=shared, top=top), "query int, doc_id long, score long")
    found = scratch.store(found, "found")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return first_n_per_key(found, ["query"], order, top).withColumn("rank", F.col("rank").cast("int"))
