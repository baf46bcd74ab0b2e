"""The stored inverted index."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import search, text_index
from ledgerloom.operators.text_index import TextIndex
from ledgerloom.session import work_path
from ledgerloom.sources.tables import materialize, scratch
from tests.conftest import scanned_rows
from tests.test_search import bm25, invoices


def documents(spark, texts, first=0):
    rows = invoices(spark, texts).withColumns(
        {"id": F.concat(F.lit("i"), (F.substring("id", 2, 9).cast("int") + first).cast("string"))}
    )
    return search.search_documents(rows)


def texts_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [
        " ".join(rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.randint(1, 60))) for _ in range(n)
    ]


def hits(found):
    return [(r["score"], r["id"]) for r in found.collect()]


@pytest.fixture
def index(spark):
    return TextIndex(spark, work_path(spark, "index"))


QUERIES = ["w1", "w3 W40 w59", "w0 w1 w2 w3 w4", "absent w17", "absent", " ,"]


def test_scores_equal_the_scan_after_deltas_and_replacements(spark, index, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 4)
    monkeypatch.setattr(text_index, "LIST_ROWS", 64)
    assert hits(index.search("w1")) == []
    texts = texts_of(1, 150)
    index.put(documents(spark, texts))
    texts[20:60] = texts_of(2, 40)
    index.put(documents(spark, texts[20:60], 20))
    texts += texts_of(3, 30)
    index.put(documents(spark, texts[150:], 150))
    texts[30:35] = ["w1 " * 40, "other", "w59", "w3 w40 w59", "w0"]
    index.put(documents(spark, texts[30:35], 30))
    for query in QUERIES:
        assert hits(index.search(query, top=7)) == bm25(texts, query)[:7], query
    shown = index.search("w1 w2", filters="invoice_number in ('n2', 'n3')").collect()
    assert shown and {r["id"] for r in shown} <= {h[1] for h in bm25(texts, "w1 w2")}
    got = {r["id"]: r["content"] for r in index.rows().collect()}
    assert got == {f"i{n}:0": t for n, t in enumerate(texts)}


def test_search_equals_search_invoices(spark, index):
    docs = search.search_documents(invoices(spark, ["x " * 900 + "needle", "needle", "nothing", ""]))
    index.put(docs)
    for query in ("needle", "x needle", "nowhere"):
        assert index.search(query).collect() == search.search_invoices(docs, query).collect()
    assert index.search("needle").columns == search.search_invoices(docs, "needle").columns


def test_only_the_words_own_pages_are_read(spark, index):
    """A vocabulary of 30,000 words over segments: a query reads blocks of its own words and no other."""
    texts = [" ".join(f"t{(n * 30 + j) % 30_000}" for j in range(30)) for n in range(1000)]
    index.put(documents(spark, texts))
    index.put(documents(spark, texts[:100], 1000))
    blocks = index.blocks_of(["t31", "t62"])
    assert blocks.count() == 4
    assert scanned_rows(blocks) <= 2 * 2 * 2 * 1000 < index.postings.rows().count() / 3


def test_blocks_that_cannot_hold_a_hit_are_left_out(spark, index, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    common = ["common " * (1 + n % 3) + "filler " * (5 + n % 40) for n in range(400)]
    index.put(documents(spark, [*common, *["common common rare"] * 3]))
    read = []
    best = TextIndex._best

    def spied(self, blocks, *rest):
        read.append(blocks.select(F.sum(F.size("entries"))).first()[0])
        return best(self, blocks, *rest)

    monkeypatch.setattr(TextIndex, "_best", spied)
    texts = [*common, *["common common rare"] * 3]
    assert hits(index.search("common rare", top=3)) == bm25(texts, "common rare")[:3]
    assert read[1] < 100 < sum("common" in t for t in texts)


def test_a_reader_sees_one_state(spark, index):
    index.put(documents(spark, ["paper", "toner paper"]))
    reader = TextIndex(spark, index.path)
    before = hits(reader.search("paper"))
    for n in range(3):
        index.put(documents(spark, [f"paper paper {n}"]))
    assert hits(reader.search("paper")) == before
    assert hits(TextIndex(spark, index.path).search("paper")) == bm25(["paper paper 2", "toner paper"], "paper")


def test_a_batch_given_again_takes_its_own_place(spark, index):
    index.put(documents(spark, ["paper one", "toner"]), "stream", 0)
    for _ in range(2):
        index.put(documents(spark, ["toner toner", "paper"], 1), "stream", 1)
    texts = ["paper one", "toner toner", "paper"]
    assert hits(index.search("paper toner")) == bm25(texts, "paper toner")


def test_what_a_delta_writes_follows_its_size(spark, index):
    def size():
        files = index._manifests.files
        folder = spark._jvm.org.apache.hadoop.fs.Path(index.path)
        return files.getContentSummary(folder).getLength()

    index.put(documents(spark, texts_of(4, 3000)))
    first = size()
    index.put(documents(spark, texts_of(5, 10), 100))
    assert size() - first < first / 10


def test_postings_move_once(spark, monkeypatch):
    """From the counts to the written run there is one exchange, by ranges of the words' hashes; before,
    words went to the word's task, and finished blocks went on to the run."""
    from ledgerloom.operators import text_index

    documents = spark.createDataFrame(
        [(f"{i}:0", f"{i}", 3, f"word{i % 5} common rare{i}") for i in range(40)],
        "id string, invoice_id string, _length int, content string",
    )
    counted = text_index._counted(documents)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning(id" in plan and "term" not in plan.split("Exchange", 1)[1].split(")")[0]
    blocks = text_index._blocks(counted, 1, 3.0)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    assert {r["term"]: r["n"] for r in blocks.collect()}["common"] == 40


def test_words_are_counted_in_place_and_documents_given_twice_together(spark):
    rows = [("a:0", "a", 3, "x y x"), ("a:1", "a", 2, "Y y"), ("b:0", "b", 3, "x y x"), ("b:0", "b", 3, "x z, x"),
            ("b:0", "b", 1, "x"), ("c:0", "c", 0, None), ("d:0", "d", 0, " "), ("c:0", "c", 0, "")]
    documents = materialize(spark.createDataFrame(rows, "id string, invoice_id string, _length int, content string"), "d")
    whole = sorted(text_index._counted(documents).collect())
    with scratch(spark) as keep:
        counted = text_index._counted_in_place(documents, keep)
        assert counted.columns == ["id", "invoice_id", "length", "term", "tf"]
        assert sorted(counted.collect()) == whole
    assert ("b:0", "b", 3, "x", 4) in [tuple(r) for r in whole] and len(whole) == 7


def test_frequent_words_are_those_of_the_whole_count(spark, monkeypatch):
    monkeypatch.setattr(text_index, "LIST_ROWS", 20)
    counted = spark.range(2000).select(
        F.when(F.col("id") < 300, F.pmod("id", F.lit(3)))
        .when(F.col("id") < 420, F.pmod("id", F.lit(6)) + 10).otherwise(F.col("id")).cast("string").alias("term")
    )
    with scratch(spark) as keep:
        found = {tuple(r) for r in text_index._frequent(counted, keep).collect()}
    assert found == {(str(t), 5) for t in range(3)}  # those of 20 documents are not among them


def test_texts_stay_where_they_are_and_nothing_is_left(spark, index, conf):
    """Replaced documents are found from the narrow table of dead postings, whatever Spark's limit for
    broadcasts, and what a put writes beside the index is removed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(work_path(spark, "x")).getParent()
    files = index._manifests.files
    names = lambda: {s.getPath().getName() for s in files.listStatus(folder)} if files.exists(folder) else set()
    before = names()
    conf(autoBroadcastJoinThreshold="100")
    index.put(documents(spark, texts_of(6, 40)))
    index.put(documents(spark, texts_of(7, 10), 5), "stream", 1)
    index.put(documents(spark, texts_of(8, 10), 10))
    index.put(documents(spark, texts_of(9, 8), 5), "stream", 1)
    shown = index.rows()
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    latest = text_index._latest(index.documents.rows()).select(shown.columns)
    assert sorted(shown.collect()) == sorted(latest.collect()) and shown.count() == 40
    assert names() - before <= {index.path.split("/")[-1]}


def test_blocks_hold_no_weights(spark, index):
    """A block's entries are in the order of their weights; only what a score is made of is stored."""
    index.put(documents(spark, ["paper", "toner paper paper", "paper paper"]))
    (block,) = index.blocks_of(["paper"]).collect()
    assert set(block["entries"][0].asDict()) == {"id", "invoice_id", "tf", "length"}
    assert [e["id"] for e in block["entries"]] == ["i2:0", "i0:0", "i1:0"]
