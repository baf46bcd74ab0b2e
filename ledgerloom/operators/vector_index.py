"""A stored index for vector search: cells, product-quantised residuals, exact re-ranking.

Vectors are scaled to length one. A bounded sample gives the centres of cells (k-means) and, for what is
left of a vector beyond its centre, a code book for each part of it. Every vector is then stored twice,
in the folder of its cell: as a code of one byte a part, and whole. A query

1. picks its nearest centres, as many as the sample's own neighbours need, and reads the codes of these
   cells only,
2. keeps the `RERANKED * k` best by their codes, looked up part by part, and
3. reads these vectors whole and ranks them by their exact cosine.

A vector is missed if its cell is not probed or its code misleads; `recall` measures how often.
"""

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators.latest import first_n_per_key
from ledgerloom.operators.search import MAX_QUERY_BYTES, TOP_HITS, usable_vectors, vector_topk
from ledgerloom.sources.runs import Manifests

TRAINED_ON = 50_000  # vectors of the sample, the first by the hash of their id
MAX_CELLS = 4096
CODE_WORDS = 256  # of a part's code book: one byte
PART_WIDTH = 4  # elements of a vector that one byte stands for
KMEANS_STEPS = 12
ASKED_OF_SAMPLE = 256  # vectors whose neighbours in the sample tell how many cells to probe
CELL_RECALL = 0.96  # of these neighbours that must lie in the cells probed
RERANKED = 12  # candidates for each hit
ROWS_AT_ONCE = 4096


def _unit(x):
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


def _nearest_centre(x, centres):
    """Index of the nearest centre of each row; the smaller index where two are as near."""
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for first in range(0, len(x), ROWS_AT_ONCE):
        out[first : first + ROWS_AT_ONCE] = (x[first : first + ROWS_AT_ONCE] @ centres.T - half).argmax(axis=1)
    return out


def _kmeans(x, k, rng):
    """Centres by k-means from a random start; an empty one moves to the row farthest from its own."""
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(KMEANS_STEPS):
        own = _nearest_centre(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, c, len(centres)) for c in x.T], axis=1)
        far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1), kind="stable")
        empty = np.flatnonzero(counts == 0)
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = x[far[: len(empty)]]
    return centres


class _Books:
    """Centres, and a code book for each part of the residuals."""

    def __init__(self, centres, books):
        self.centres, self.books = centres, books

    @classmethod
    def trained(cls, x, cells, seed):
        rng = np.random.default_rng(seed)
        centres = _kmeans(x, cells, rng)
        residual = x - centres[_nearest_centre(x, centres)]
        cuts = range(0, x.shape[1], PART_WIDTH)
        books = [_kmeans(residual[:, a : a + PART_WIDTH], CODE_WORDS, rng) for a in cuts]
        return cls(centres, books)

    def encoded(self, x):
        own = _nearest_centre(x, self.centres)
        residual = x - self.centres[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for i, book in enumerate(self.books):
            codes[:, i] = _nearest_centre(residual[:, i * PART_WIDTH : (i + 1) * PART_WIDTH], book)
        return own, codes

    def ranks_of(self, queries):
        """The centres from the nearest to the farthest, by distance as vectors are assigned to them."""
        scores = queries @ self.centres.T
        return scores, np.argsort((self.centres**2).sum(axis=1) / 2 - scores, axis=1, kind="stable")

    def probes_needed(self, x, k):
        """How many cells hold `CELL_RECALL` of the `k` nearest neighbours, in the sample, of some of it."""
        asked = x[:: max(1, len(x) // ASKED_OF_SAMPLE)][:ASKED_OF_SAMPLE]
        products = asked @ x.T
        products[products >= 1 - 1e-9] = -2.0  # itself and its copies
        near = np.argsort(-products, axis=1, kind="stable")[:, :k]
        place = np.argsort(self.ranks_of(asked)[1], axis=1)
        needed = np.take_along_axis(place, _nearest_centre(x, self.centres)[near], axis=1)
        return int(np.quantile(needed, CELL_RECALL, method="higher")) + 1 if needed.size else 1

    def tables(self, queries):
        """For each query its products with all code words, part by part."""
        return [
            queries[:, i * PART_WIDTH : (i + 1) * PART_WIDTH] @ book.T for i, book in enumerate(self.books)
        ]

    def to_json(self):
        return {"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books]}

    @classmethod
    def from_json(cls, entry):
        return cls(np.array(entry["centres"]), [np.array(b) for b in entry["books"]])


def _rows(batch, column=1):
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return _unit(values.reshape(batch.num_rows, -1).astype("float64")) if batch.num_rows else None


def _encode(batches, books):
    for batch in batches:
        x = _rows(batch)
        if x is not None:
            cells, codes = books.value.encoded(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(cells.astype(np.int32)),
                    pa.array([row.tobytes() for row in codes], pa.binary()),
                    batch.column(1),
                ],
                names=["id", "cell", "code", "vector"],
            )


def _by_codes(batches, shared, keep):
    """The `keep` best vectors of a partition for each query that probes their cell, by their codes."""
    tables, centre_scores, probed = shared.value
    best, id_type = {}, None
    for batch in batches:
        id_type = batch.schema.field("id").type
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8)
        codes = codes.reshape(len(cells), -1)
        ids = np.array(batch.column("id").to_pylist(), dtype=object)
        for cell in np.unique(cells):
            own = np.flatnonzero(cells == cell)
            asking = probed.get(int(cell), np.empty(0, np.int64))
            scores = centre_scores[asking, cell][:, None] + sum(
                table[np.ix_(asking, codes[own, i])] for i, table in enumerate(tables)
            )
            for query, row in zip(asking.tolist(), scores):
                near = np.argsort(-row, kind="stable")[:keep]
                found = list(zip((-row[near]).tolist(), ids[own[near]].tolist(), [int(cell)] * len(near)))
                best[query] = sorted(best.get(query, []) + found)[:keep]
    rows = [(q, s, i, c) for q, found in best.items() for s, i, c in found]
    columns = zip(*rows) if rows else [[]] * 4
    kinds = [pa.int32(), pa.float64(), id_type or pa.int64(), pa.int32()]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
    yield pa.RecordBatch.from_arrays(arrays, names=["query", "negative", "id", "cell"])


class VectorIndex:
    """The index below `path`.

    Vectors that have no cosine with others (another width than `width`, a null element, length zero)
    are left out, as `vector_topk` does.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self._manifests = Manifests(spark, path)
        entries = self._manifests.entries()
        self.entry = entries[0] if entries else None
        self.books = self.entry and _Books.from_json(self.entry)

    def build(self, vectors, id_column="id", vector_column="content_vector", cells=None, seed=7):
        """Train on a sample of at most `TRAINED_ON` vectors and store all. `cells` are as many as the
        square root of the vectors by default, `MAX_CELLS` at most. Returns self."""
        width = vectors.select(F.max(F.size(vector_column))).first()[0] or 0
        stored = usable_vectors(vectors, id_column, vector_column, width)
        n = stored.count()
        chosen = stored.orderBy(F.xxhash64("id"), "id").limit(min(n, TRAINED_ON)).select("vector")
        sample = np.array([row["vector"] for row in chosen.collect()], dtype="float64").reshape(-1, max(width, 1))
        if cells is None:
            cells = min(MAX_CELLS, max(1, round(math.sqrt(n))))
        sample = _unit(sample)
        books = _Books.trained(sample, cells, seed) if n else _Books(np.zeros((1, max(width, 1))), [])
        probes = books.probes_needed(sample, TOP_HITS)
        shared = self.spark.sparkContext.broadcast(books)
        kind = stored.schema["id"].dataType.simpleString()
        items = stored.schema["vector"].dataType.simpleString()
        encoded = stored.mapInArrow(
            partial(_encode, books=shared), f"id {kind}, cell int, code binary, vector {items}"
        )
        folder = f"v={(self._manifests.numbers() or [0])[-1] + 1}"
        # A large cell lies in several files, as its ids are part of the order.
        laid_out = encoded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        laid_out.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/{folder}")
        self.entry = {"folder": folder, "width": width, "id": kind, "vector": items, "n": n, "probes": probes}
        self.entry |= books.to_json()
        self._manifests.commit(lambda entries: [self.entry])
        self.books = books
        return self

    def _cells(self, cells, columns):
        """Some columns of some cells: other folders are not read, other columns neither."""
        schema = {"id": self.entry["id"], "code": "binary", "vector": self.entry["vector"], "cell": "int"}
        rows = self.spark.read.schema(", ".join(f"{c} {schema[c]}" for c in [*columns, "cell"]))
        return rows.parquet(f"{self.path}/{self.entry['folder']}").filter(F.col("cell").isin(list(cells)))

    def search(self, queries, k=TOP_HITS, probes=None, query_id="query_id", query_vector="vector"):
        """Query id, id, exact cosine as `score` and `rank` of up to `k` vectors for each query.

        `probes` are the cells to read for a query, by default what the sample needed. `queries` is the stated query set, of one width and at most `MAX_QUERY_BYTES`.
        """
        spark = self.spark
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
        size = asked.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.min(F.size("vector"))).first()
        if not size[0] or not self.entry["n"]:
            kind = asked.schema["query_id"].dataType.simpleString()
            return spark.createDataFrame([], f"query_id {kind}, id {self.entry['id']}, score double, rank int")
        if size[1] != self.entry["width"] or size[2] != size[1]:
            raise ValueError(f"the query vectors must have the width {self.entry['width']}")
        if size[0] * size[1] * 8 > MAX_QUERY_BYTES:
            raise ValueError(f"more than {MAX_QUERY_BYTES} bytes of queries: ask in several calls")
        rows = asked.orderBy("query_id").collect()
        matrix = _unit(np.array([row["vector"] for row in rows], dtype="float64"))
        centre_scores, near = self.books.ranks_of(matrix)
        near = near[:, : probes or self.entry["probes"]]
        probed = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((self.books.tables(matrix), centre_scores, probed))
        keep = RERANKED * k
        kind = self.entry["id"]
        found = self._cells(probed, ["id", "code"]).mapInArrow(
            partial(_by_codes, shared=shared, keep=keep), f"query int, negative double, id {kind}, cell int"
        )
        candidates = first_n_per_key(found, ["query"], ["negative", "id"], keep).select("query", "id", "cell")
        names = spark.createDataFrame(
            [(i, row["query_id"], row["vector"]) for i, row in enumerate(rows)],
            f"query int, query_id {asked.schema['query_id'].dataType.simpleString()}, asked array<double>",
        )
        whole = self._cells(probed, ["id", "vector"]).join(candidates, ["cell", "id"])
        whole = whole.join(names, "query")
        ranked = first_n_per_key(
            whole.select("query_id", "id", F.round(_cosine("vector", "asked"), 6).alias("score")),
            ["query_id"], [F.desc("score"), F.col("id")], k,
        )
        return ranked.select("query_id", "id", "score", "rank")


def _cosine(a, b):
    def product(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p
        )

    return product(a, b) / F.sqrt(product(a, a) * product(b, b))


def recall(index, vectors, queries, k=TOP_HITS, id_column="id", vector_column="content_vector", **options):
    """The share of the exact best `k` of all queries that the index finds."""
    exact = vector_topk(vectors, queries, k, id_column, vector_column).select("query_id", "id")
    found = index.search(queries, k, **options).select("query_id", "id")
    hits, all_of_them = found.join(exact, ["query_id", "id"]).count(), exact.count()
    return hits / all_of_them if all_of_them else 1.0
