"""Text chunks, search documents, keyword search and vector search."""

import math
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import has_text
from ledgerloom.operators.latest import (
    first_n_per_key,
    first_per_key,
    first_per_repeated_key,
    row_hash,
)
from ledgerloom.session import delete, work_path

# Chunk size, stored text length, hits and snippet length.
CHUNK_CHARS = 4000
STORED_TEXT_CHARS = 10000
TOP_HITS = 10
SNIPPET_CHARS = 500

# Published BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75

HIT_COLUMNS = [
    "id", "invoice_id", "content", "vendor_name", "invoice_number", "spend_category",
]

# Query vectors scored at once, and the size of the whole query set.
QUERY_BLOCK = 256
MAX_QUERY_BYTES = 256 << 20


def chunks_of(c, max_chars=CHUNK_CHARS):
    """A text cut into an array of chunks of at most `max_chars` characters.

    A chunk ends behind the last line break of its window if that lies beyond the middle of the
    window, else at the window's end; the rest of a text that fits one chunk stays whole. These are
    the three branches of the pattern, which walks the text once, whatever its length.
    """
    half = max_chars // 2
    pattern = rf"(?s).{{1,{max_chars}}}\z|.{{{half + 1},{max_chars - 1}}}\n|.{{1,{max_chars}}}"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def chunk_text(df, text="raw_text", max_chars=CHUNK_CHARS):
    """One row per chunk with `chunk_id` from 0 and `content`. Blank texts give none."""
    return df.filter(has_text(text)).select(
        *[c for c in df.columns if c != text],
        F.posexplode(chunks_of(F.col(text), max_chars)).alias("chunk_id", "content"),
    )


def cut_stored_text(df, limit=STORED_TEXT_CHARS):
    """Cut the stored text at a length, for stores that bound their records."""
    return df.withColumn("raw_text", F.substring("raw_text", 1, limit))


def search_documents(invoices, vectors=None, sequence=None, settle=False, unique=False):
    """The documents of the search index: one per chunk, with the invoice's metadata.

    An invoice that is given several times counts once: the latest by the column `sequence`, if
    named, ties told apart by a hash (`settle` as in `first_per_repeated_key`, for stored tables).
    With `unique` the caller says that each id comes once, and no rows move.
    `vectors` holds `id` (of the chunk) and `content_vector`; documents without one get null.
    """
    order = [F.col(sequence).desc_nulls_last()] if sequence else []
    order.append("_row_hash")
    hashed = invoices.withColumn("_row_hash", row_hash(invoices))
    if unique:
        once = invoices
    elif settle:
        once = first_per_repeated_key(hashed, ["id"], order, settle)
    else:
        once = first_per_key(hashed, ["id"], order)
    chunks = chunk_text(once.withColumnRenamed("id", "invoice_id"))
    documents = chunks.select(
        F.concat_ws(":", "invoice_id", "chunk_id").alias("id"),
        "invoice_id",
        F.col("chunk_id").cast("string").alias("chunk_id"),
        "content",
        "vendor_name",
        "invoice_number",
        "spend_category",
        "invoice_date",
        "total_amount",
        "user_id",
    )
    return documents if vectors is None else documents.join(vectors, "id", "left")


def words_of(c):
    """Lower-cased words of a text: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(query):
    """Distinct words of a query, by the same rule as the texts'."""
    words, word = [], ""
    for char in query.lower() + " ":
        if char.isalnum():
            word += char
        elif word:
            words.append(word)
            word = ""
    return list(dict.fromkeys(words))


def search_invoices(documents, query, top=TOP_HITS, filters=None):
    """The best documents for a keyword query by BM25, score in `score`.

    `filters` is an SQL condition on the documents' columns, such as `user_id = 'u1'`. It decides
    which documents may be shown; scores stay those of the whole collection.

    Each text is split into words once, in a pass that writes the hits and observes the collection's
    figures. The hits are ranked, and what the pass wrote is removed; the `top` best ones, a bounded
    number, go through the driver.
    """
    spark = documents.sparkSession
    words = query_words(query)
    if not words:
        return documents.select(*_hit_columns(), F.lit(0.0).alias("score")).limit(0)
    allowed = F.lit(True) if filters is None else F.coalesce(F.expr(filters), F.lit(False))
    split = documents.select(
        *_hit_columns(), words_of(F.col("content")).alias("_words"), allowed.alias("_allowed")
    )
    counts = [_count_of(word).alias(f"_tf{i}") for i, word in enumerate(words)]
    counted = split.select(*HIT_COLUMNS, "_allowed", F.size("_words").alias("_length"), *counts)
    tf = [F.col(f"_tf{i}") for i in range(len(words))]
    observed = Observation()
    counted = counted.observe(
        observed,
        F.count(F.lit(1)).alias("n"),
        F.sum("_length").alias("length"),
        *[F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(tf)],
    )
    path = work_path(spark, "search-hits")
    is_hit = F.col("_allowed") & reduce(lambda a, b: a | b, [t > 0 for t in tf])
    hits = counted.filter(is_hit)
    hits.write.parquet(path)
    figures = observed.get
    n = figures["n"]
    average = (figures["length"] or 0) / n if n else 0.0

    def part(i):
        df = figures[f"df{i}"]
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = 1 - BM25_B + BM25_B * F.col("_length") / F.lit(average or 1.0)
        return F.lit(idf) * tf[i] * (BM25_K1 + 1) / (tf[i] + BM25_K1 * norm)

    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(words))])
    best = (
        spark.read.schema(hits.schema)
        .parquet(path)
        .select(*HIT_COLUMNS, F.round(score, 6).alias("score"))
        .orderBy(F.desc("score"), "id")
        .limit(top)
    )
    result = spark.createDataFrame(best.toArrow(), best.schema)
    delete(spark, path)
    return result


def _count_of(word):
    return F.size("_words") - F.size(F.array_remove("_words", word))


def _hit_columns():
    snippet = F.substring("content", 1, SNIPPET_CHARS).alias("content")
    return [snippet if c == "content" else F.col(c) for c in HIT_COLUMNS]


def vector_topk(
    vectors,
    queries,
    k=TOP_HITS,
    id_column="id",
    vector_column="content_vector",
    query_id="query_id",
    query_vector="vector",
):
    """The `k` nearest vectors by cosine for each query, exact; ties go to the smaller id.

    `queries` is a table of query ids and vectors, the stated query set: all of one width, and at most
    `MAX_QUERY_BYTES` in all, as it goes out with the tasks. Vectors that have no cosine with them
    (another width, a null element, length zero) are not ranked. The stored vectors are read once;
    each task scores its batches against the queries, block by block, and keeps a running best of
    each query, so a task sends `k` rows for each query at most.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    size = asked.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"),
        F.min(F.size("vector")).alias("least"),
    ).first()
    if size["width"] != size["least"]:
        raise ValueError("the query vectors must have one width")
    width = size["width"] or 0
    if size["n"] * width * 8 > MAX_QUERY_BYTES:
        raise ValueError(f"more than {MAX_QUERY_BYTES} bytes of queries: ask in several calls")
    rows = asked.orderBy("query_id").collect()
    matrix = np.array([row["vector"] for row in rows], dtype="float64").reshape(len(rows), width)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if len(rows) else matrix
    shared = spark.sparkContext.broadcast(matrix)
    stored = usable_vectors(vectors, id_column, vector_column, width)
    id_type = stored.schema["id"].dataType.simpleString()
    best = stored.mapInArrow(
        partial(_nearest, shared=shared, k=k), f"query int, id {id_type}, score double"
    )
    ranked = first_n_per_key(best, ["query"], [F.desc("score"), F.col("id")], k)
    kind = asked.schema["query_id"].dataType.simpleString()
    names = spark.createDataFrame(
        [(i, row["query_id"]) for i, row in enumerate(rows)], f"query int, query_id {kind}"
    )
    return ranked.join(F.broadcast(names), "query").select("query_id", "id", "score", "rank")


def usable_vectors(vectors, id_column, vector_column, width):
    """`id` and `vector` of the vectors of a width that have no null element and are not zero."""
    vector = F.col(vector_column)
    whole = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    some = F.exists(vector, lambda x: x != 0)
    return vectors.filter(whole & some).select(F.col(id_column).alias("id"), vector.alias("vector"))


def _nearest(batches, shared, k):
    """The best `k` stored vectors of a partition for each query, kept up to date batch by batch."""
    matrix, kept, id_type = shared.value, {}, None
    for batch in batches:
        id_type = batch.schema.field(0).type
        ids = batch.column(0).to_pandas()
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        values = values.reshape(-1, matrix.shape[1]).astype("float64")
        lengths = np.linalg.norm(values, axis=1)
        usable = lengths > 0
        ids, values = ids[usable], values[usable] / lengths[usable, None]
        for first in range(0, len(matrix), QUERY_BLOCK):
            scores = np.round(values @ matrix[first : first + QUERY_BLOCK].T, 6)
            # Only scores from the k-th best on, ties included, need sorting.
            low = max(len(scores) - k, 0)
            limits = np.partition(scores, low, axis=0)[low] if low else np.full(scores.shape[1], -2.0)
            for i in range(scores.shape[1]):
                near = scores[:, i] >= limits[i]
                found = pd.DataFrame({"id": ids[near], "score": scores[near, i]})
                if first + i in kept:
                    found = pd.concat([kept[first + i], found])
                found = found.sort_values(["score", "id"], ascending=[False, True])
                kept[first + i] = found.head(k)
    for query, best in kept.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(best), query, dtype="int32")),
                pa.array(best["id"], type=id_type),
                pa.array(best["score"].to_numpy()),
            ],
            names=["query", "id", "score"],
        )
