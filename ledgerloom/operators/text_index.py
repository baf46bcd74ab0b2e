"""A stored inverted index for keyword search, with delta segments.

For every word the index has blocks of at most `BLOCK` postings, the weightiest first, each with the
largest count and the least length in it. A query opens the pages of its own words only, and of their
blocks only those that can hold one of the best documents:

1. Counts and bounds of the words' blocks give each word's weight and the most it can add to a score.
2. The first blocks of the words give documents whose scores, so far, are a lower bound for the last
   of the best.
3. A block is read if its bound and the most of all other words together reach that lower bound. A
   document with a posting in a block that is left out cannot be among the best, so the scores of those
   that are among them are whole.

New documents are a new segment. An invoice given again replaces its documents: its old postings are
marked as dead and its words' counts are taken back, so scores are always those of the documents that
are there now. Segments are merged by size. A manifest names the states of the tables that belong
together: a reader that has opened the index sees one state of it, whatever is written meanwhile.
"""

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import search
from ledgerloom.operators.lookup import group_values, join_values, sent_out
from ledgerloom.operators.search import BM25_B, BM25_K1, HIT_COLUMNS, TOP_HITS, query_words, words_of
from ledgerloom.sources.runs import Manifests, RunTable
from ledgerloom.sources.tables import materialize, scratch

BLOCK = 128
FIRST_BLOCKS = 2  # of a word in a segment, for the lower bound
LIST_ROWS = 1 << 16  # postings of a word that one task puts into blocks
TIE = 1e-5  # scores are compared after rounding to six decimals

_HASH = "_hash"
_ENTRY = "struct<id:string,invoice_id:string,tf:int,length:int>"
POSTINGS = (
    f"{_HASH} long, term string, segment long, block long, n long, most int, least int, entries array<{_ENTRY}>"
)
DEAD = f"{_HASH} long, invoice_id string, segment long"
FIGURES = f"{_HASH} long, documents long, words long"


def _latest(rows):
    """The documents of each invoice's last segment."""
    last = group_values(rows, ["invoice_id"], _last=F.max("segment"))
    return join_values(rows, F.struct("invoice_id"), last).filter("segment = _last").drop("_last")


def _sums(rows):
    return rows.groupBy(_HASH).agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"))


def _saturated(tf, length, average):
    """The part of a word's score that its count and the document's length decide; it grows with the
    first and falls with the second."""
    norm = 1 - BM25_B + BM25_B * length / F.lit(average or 1.0)
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * norm)


class TextIndex:
    """The index below `path`, as it is when it is opened; `put` moves it on.

    Documents are those of `search.search_documents`, here without `content_vector`. A null or blank
    `content` is a document without words. Ids must not be null.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self._manifests = Manifests(spark, path)
        self._open()

    def _open(self):
        entries = self._manifests.entries()
        self.state = entries[0] if entries else {"segment": 0}
        schema = self.state.get("documents_schema")
        self.postings = self._table("postings", POSTINGS)
        self.dead = self._table("dead", DEAD, lambda rows: rows.groupBy(_HASH, "invoice_id").agg(F.max("segment").alias("segment")))
        self.figures = self._table("figures", FIGURES, _sums)
        self.documents = self._table("documents", schema, _latest) if schema else None

    def _table(self, name, schema, combine=None, state="as opened"):
        number = self.state.get(name, 0) if state == "as opened" else state
        return RunTable(self.spark, f"{self.path}/{name}", schema, _HASH, combine, number)

    # Writing ------------------------------------------------------------------------------------------

    def put(self, documents, writer="put", number=None):
        """Add documents, in place of those that their invoices have. `writer` and `number` name a batch
        that may be given again, as a stream's last one: it then takes the place of its first attempt.
        One writer at a time.

        Reads and writes in proportion to the documents given, and to those that they replace. The
        documents are stored first, and their words are counted where they were stored.
        """
        with scratch(self.spark) as keep:
            self._put(documents, writer, number, keep)
        self._open()

    def _put(self, documents, writer, number, keep):
        self._open()
        segment = self.state["segment"] + 1
        own = (writer, segment if number is None else number)
        words = words_of(F.coalesce("content", F.lit("")))
        kept = [c for c in documents.columns if c != "content_vector"]
        new = documents.select(
            F.xxhash64("invoice_id").alias(_HASH), *kept,
            F.lit(segment).cast("long").alias("segment"), F.size(words).alias("_length"),
        )
        columns = new.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        state = {"segment": segment, "documents_schema": schema}

        def store(name, schema, combine, rows):
            table = self._table(name, schema, combine, state=None)
            stored = table.put(rows, *own, ranged=name == "postings")
            state[name] = table.last()
            return stored

        new = store("documents", schema, _latest, new)
        before, gone = self.documents, None
        if before is not None:
            asked = keep(new.select(_HASH, "invoice_id").distinct(), "index-asked")
            old = before.find(sent_out(asked.select(_HASH)), own)
            old = old.join(sent_out(asked.select("invoice_id")), "invoice_id", "left_semi")
            gone = keep(self._current(old, own).select(columns), "index-replaced")
        one = F.count(F.lit(1)), F.coalesce(F.sum("_length"), F.lit(0))
        figures = new.agg(one[0].alias("documents"), one[1].alias("words"))
        if gone is not None:
            less = gone.agg((-one[0]).alias("documents"), (-one[1]).alias("words"))
            figures = figures.unionAll(less)
        figures = figures.withColumn(_HASH, F.lit(0).cast("long"))
        average = figures.agg(F.sum("words") / F.greatest(F.sum("documents"), F.lit(1))).first()[0]
        store("figures", FIGURES, _sums, _sums(figures))
        postings = _blocks(_counted_in_place(new, keep), segment, average, keep)
        if gone is not None:
            postings = postings.unionByName(_taken_back(_counted_in_place(gone, keep), segment))
            dead = gone.select(_HASH, "invoice_id", F.lit(segment).cast("long").alias("segment")).distinct()
            store("dead", DEAD, self.dead.combine, dead)
        store("postings", POSTINGS, None, postings)
        self._manifests.commit(lambda entries: [state])

    def _current(self, documents, without=None):
        """Those of some documents that no later segment has replaced. Only the table of dead postings is
        asked, which names the replaced invoices and no other; the texts stay where they are as long as it
        can be sent out."""
        runs = self.dead.runs()
        if not runs:
            return documents
        size = sum(f["bytes"] for r in runs for f in r["files"])
        dead = group_values(self.dead.rows(without), ["invoice_id"], _until=F.max("segment"))
        found = join_values(documents, F.struct("invoice_id"), sent_out(dead, size))
        return found.filter("_until is null or segment >= _until").drop("_until")

    # Reading ------------------------------------------------------------------------------------------

    def rows(self):
        """All documents that are there, with the columns they were given with."""
        if self.documents is None:
            raise FileNotFoundError(f"nothing was put into {self.path}")
        return self._current(self.documents.rows()).drop(_HASH, "segment", "_length")

    def blocks_of(self, words):
        """The blocks of some words."""
        asked = self.spark.createDataFrame([(w,) for w in words], "term string")
        found = self.postings.find(asked.select(F.xxhash64("term").alias(_HASH)))
        return found.filter(F.col("term").isin(words))

    def search(self, query, top=TOP_HITS, filters=None):
        """The best documents for a keyword query: columns, scores and order of `search_invoices`.

        `filters` is an SQL condition on the documents' columns that decides which may be shown; the
        documents' columns it names are then read for all documents.
        """
        words = query_words(query)
        total = self.figures.rows().agg(F.sum("documents"), F.sum("words")).first()
        if self.documents is None or not words or not total[0]:
            return self._hits([])
        documents, average = total[0], (total[1] or 0) / total[0]
        blocks = self.blocks_of(words)
        bound = _saturated(F.col("most"), F.col("least"), average)
        known = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(bound).alias("most")).collect()
        weights, limits = {}, {}
        for row in known:
            if row["df"] > 0:
                weights[row["term"]] = math.log(1 + (documents - row["df"] + 0.5) / (row["df"] + 0.5))
                limits[row["term"]] = weights[row["term"]] * row["most"]
        words = [w for w in words if w in weights]
        if not words:
            return self._hits([])
        first = self._best(blocks.filter((F.col("block") >= 0) & (F.col("block") % LIST_ROWS < FIRST_BLOCKS)),
                           words, weights, average, top, filters)
        low = first[-1]["score"] - TIE if len(first) == top else 0.0
        rest = sum(limits.values())
        reaches = reduce(
            lambda a, b: a | b,
            [(F.col("term") == w) & (bound * weights[w] + (rest - limits[w]) >= low) for w in words],
        )
        return self._hits(self._best(blocks.filter((F.col("n") > 0) & reaches), words, weights, average, top, filters))

    def _best(self, blocks, words, weights, average, top, filters):
        """The best documents by their postings in these blocks, those that are dead left out."""
        entry = blocks.select("term", "segment", F.explode("entries").alias("e"))
        tf = [F.sum(F.when(F.col("term") == w, F.col("e.tf"))).alias(f"tf{i}") for i, w in enumerate(words)]
        found = entry.groupBy(F.col("e.id").alias("id"), F.col("e.invoice_id").alias("invoice_id"), "segment").agg(
            F.max("e.length").alias("length"), *tf
        )
        dead = self.dead.rows().groupBy("invoice_id").agg(F.max("segment").alias("until"))
        found = found.join(dead, "invoice_id", "left").filter("until is null or segment >= until")
        if filters is not None:
            found = found.join(self.rows().filter(filters).select("id"), "id", "left_semi")
        parts = [
            F.lit(weights[w]) * F.coalesce(_saturated(F.col(f"tf{i}"), F.col("length"), average), F.lit(0.0))
            for i, w in enumerate(words)
        ]
        score = F.round(reduce(lambda a, b: a + b, parts), 6).alias("score")
        return found.select("id", "invoice_id", score).orderBy(F.desc("score"), "id").limit(top).collect()

    def _hits(self, best):
        """The hits' columns, looked up in the documents."""
        if not best:
            schema = ", ".join(f"{c} string" for c in HIT_COLUMNS)
            return self.spark.createDataFrame([], f"{schema}, score double")
        scores = self.spark.createDataFrame(best, "id string, invoice_id string, score double")
        found = self.documents.find(scores.select(F.xxhash64("invoice_id").alias(_HASH)))
        rows = _latest(found).join(F.broadcast(scores.select("id", "score")), "id")
        hits = rows.select(*search._hit_columns(), "score").orderBy(F.desc("score"), "id")
        return self.spark.createDataFrame(hits.toArrow(), hits.schema)


def _counted(documents):
    """A row for each document and word of it, with its count. Texts move to where their words are
    counted, which takes less room than moving the words."""
    words = F.explode(words_of(F.coalesce("content", F.lit("")))).alias("term")
    texts = documents.select("id", "invoice_id", F.col("_length").alias("length"), "content")
    return (
        texts.repartition("id", "invoice_id")
        .select("id", "invoice_id", "length", words)
        .groupBy("id", "invoice_id", "length", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )


def _counted_in_place(documents, keep):
    """The same, but only documents that come more than once move: a text's words are sorted, and a word's
    count is the way from its first place to the next word's."""
    key = F.struct("id", "invoice_id", "_length")
    twice = group_values(documents, ["id", "invoice_id", "_length"], _n=F.count(F.lit(1))).filter("_n > 1").drop("_n")
    twice = sent_out(keep(twice, "index-twice"))
    words, first = F.col("_words"), F.col("_first")
    places = F.transform("_words", lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i))
    ends = lambda n: F.coalesce(F.get(first, n + 1), F.size(words))
    counts = F.transform("_first", lambda i, n: F.struct(F.get(words, i).alias("term"), (ends(n) - i).alias("tf")))
    once = (
        join_values(documents, key, twice, "left_anti")
        .select("id", "invoice_id", F.col("_length").alias("length"),
                F.sort_array(words_of(F.coalesce("content", F.lit("")))).alias("_words"))
        .withColumn("_first", F.array_compact(places))
        .select("id", "invoice_id", "length", F.inline(counts))
    )
    return once.unionByName(_counted(join_values(documents, key, twice, "left_semi")))


def _frequent(counted, keep):
    """The words that more than `LIST_ROWS` documents have, with the number of their lists. Words are
    counted one by one only where all those with the same remainder of the hash reach that together."""
    buckets = 4 * (counted.count() // LIST_ROWS) + 1
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("_bucket")
    full = counted.groupBy(bucket).agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > LIST_ROWS)
    full = keep(full.select("_bucket"), "index-buckets")
    some = counted.select("term", bucket).join(F.broadcast(full), "_bucket", "left_semi")
    frequent = some.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > LIST_ROWS)
    return keep(frequent.select("term", F.ceil(F.col("df") / LIST_ROWS).alias("lists")), "index-lists")


def _blocks(counted, segment, average, keep=materialize):
    """The blocks of a segment. The list of a word that very many documents have is cut by the documents'
    hash, so that no task orders more than about `LIST_ROWS` postings of one word."""
    counted = keep(counted, "index-counts")
    lists = sent_out(_frequent(counted, keep))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("lists")), F.lit(0))
    rows = counted.join(lists, "term", "left").select("term", part.alias("part"), "id", "invoice_id", "tf", "length")
    # Postings move once, to the range of hashes where their blocks are written.
    rows = rows.repartitionByRange(F.xxhash64("term"), "part").withColumns(
        {_HASH: F.xxhash64("term"), "impact": _saturated(F.col("tf"), F.col("length"), average)}
    )
    by_impact = Window.partitionBy(_HASH, "term", "part").orderBy(F.desc("impact"), "id")
    rows = rows.withColumn("_block", F.floor((F.row_number().over(by_impact) - 1) / BLOCK))
    entries = F.sort_array(F.collect_list(F.struct("impact", "id", "invoice_id", "tf", "length")), asc=False)
    entries = F.transform(entries, lambda e: e.dropFields("impact"))
    return rows.groupBy(_HASH, "term", "part", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"),
        entries.alias("entries"),
    ).select(
        _HASH, "term", F.lit(segment).cast("long").alias("segment"),
        (F.col("part") * LIST_ROWS + F.col("_block")).alias("block"), "n", "most", "least", "entries",
    )


def _taken_back(counted, segment):
    """Blocks without postings that lower the words' counts."""
    lowered = counted.groupBy("term").agg((-F.count(F.lit(1))).alias("n"))
    return lowered.repartitionByRange(F.xxhash64("term")).select(
        F.xxhash64("term").alias(_HASH), "term", F.lit(segment).cast("long").alias("segment"),
        F.lit(-1).cast("long").alias("block"), "n", F.lit(0).alias("most"), F.lit(0).alias("least"),
        F.array().cast(f"array<{_ENTRY}>").alias("entries"),
    )
