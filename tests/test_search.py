"""Chunks, search documents, keyword search and vector search."""

import math
import pathlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import search
from ledgerloom.session import work_path
from ledgerloom.sources.tables import read_index, read_table, write_index


def cut_by_hand(text, size):
    """The chunking rule, one window after the other."""
    pieces = []
    while text:
        take = len(text) if len(text) <= size else size
        if take < len(text):
            breaks = [i for i, c in enumerate(text[:size]) if c == "\n" and i > size // 2]
            take = breaks[-1] + 1 if breaks else size
        pieces.append(text[:take])
        text = text[take:]
    return pieces


def chunks(spark, texts, size):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw_text string")
    found = {}
    for r in search.chunk_text(rows, max_chars=size).orderBy("i", "chunk_id").collect():
        found.setdefault(r["i"], []).append(r["content"])
    return found


@settings(max_examples=10, deadline=None)
@given(
    st.lists(st.text(st.sampled_from("ab\n\r 　é😀"), max_size=80), min_size=5, max_size=30),
    st.sampled_from([4, 5, 10, 16]),
)
def test_chunks_follow_the_rule(spark, texts, size):
    got = chunks(spark, texts, size)
    for i, text in enumerate(texts):
        expected = cut_by_hand(text, size) if text.strip() else []
        assert got.get(i, []) == expected
        assert "".join(expected) in (text, "")


def test_long_texts_are_chunked_whole(spark):
    long = ("word " * 700 + "\n") * 300
    flat = "x" * 1_000_003
    wide = "a😀" * 60_000
    got = chunks(spark, [long, flat, wide], search.CHUNK_CHARS)
    for i, text in enumerate([long, flat, wide]):
        assert "".join(got[i]) == text
        assert got[i] == cut_by_hand(text, search.CHUNK_CHARS)


def invoices(spark, texts):
    return spark.createDataFrame(
        [(f"i{n}", t, "v", f"n{n}", "IT", "2024-01-01", 1.0, "u") for n, t in enumerate(texts)],
        """id string, raw_text string, vendor_name string, invoice_number string,
           spend_category string, invoice_date string, total_amount double, user_id string""",
    )


def test_search_documents(spark, tmp_path):
    text = "a" * 4500
    vectors = spark.createDataFrame([("i0:1", [1.0])], "id string, content_vector array<float>")
    docs = search.search_documents(invoices(spark, [text, "", "  ", None, "b"]), vectors)
    got = {r["id"]: r for r in docs.collect()}
    assert set(got) == {"i0:0", "i0:1", "i4:0"}
    assert got["i0:1"]["chunk_id"] == "1"
    assert got["i0:1"]["content_vector"] == [1.0]
    assert got["i0:0"]["content_vector"] is None
    assert got["i4:0"]["invoice_id"] == "i4"
    path = str(tmp_path / "index")
    for part in (docs, docs.limit(0), docs):
        write_index(part, path)
        assert read_index(spark, path).count() == 3
    # A shorter text leaves no chunk of the longer one behind, and other invoices alone.
    again = search.search_documents(invoices(spark, ["short"]), vectors)
    write_index(again, path)
    assert {r["id"]: r["content"] for r in read_index(spark, path).collect()} == {
        "i0:0": "short", "i4:0": "b",
    }


@pytest.mark.parametrize("settle", [False, True])
def test_an_invoice_given_twice_is_one_document(spark, settle):
    rows = invoices(spark, ["old", "other"]).unionByName(
        invoices(spark, ["new"]).withColumn("invoice_date", F.lit("2024-02-01"))
    )
    docs = search.search_documents(rows, sequence="invoice_date", settle=settle)
    assert {r["id"]: r["content"] for r in docs.collect()} == {"i0:0": "new", "i1:0": "other"}
    assert docs.count() == 2


def test_search_leaves_nothing_behind(spark):
    before = set(pathlib.Path(work_path(spark, "x")).parent.glob("search-*"))
    docs = search.search_documents(invoices(spark, TEXTS))
    assert search.search_invoices(docs, "paper").count() > 0
    assert set(pathlib.Path(work_path(spark, "x")).parent.glob("search-*")) == before


def test_stored_text_cut(spark):
    rows = spark.createDataFrame([("é" * 20000,)], "raw_text string")
    assert search.cut_stored_text(rows).select(F.char_length("raw_text")).first()[0] == 10000


TEXTS = [
    "Office supplies: paper, toner; PAPER.",
    "Travel to the office",
    "Paper",
    "nothing here",
    "toner " * 50 + "office",
    "",
] * 3


def bm25(texts, query):
    tokens = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    kept = [i for i, t in enumerate(texts) if t.strip()]
    average = sum(len(tokens[i]) for i in kept) / len(kept)
    scores = {}
    for word in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())):
        df = sum(word in tokens[i] for i in kept)
        idf = math.log(1 + (len(kept) - df + 0.5) / (df + 0.5))
        for i in kept:
            tf = tokens[i].count(word)
            if tf:
                norm = tf + 1.2 * (0.25 + 0.75 * len(tokens[i]) / average)
                scores[i] = scores.get(i, 0.0) + idf * tf * 2.2 / norm
    return sorted(((round(s, 6), f"i{i}:0") for i, s in scores.items()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("query", ["paper", "Office, toner office", "absent", "to-ner paper"])
def test_keyword_search_scores_by_bm25(spark, query):
    docs = search.search_documents(invoices(spark, TEXTS))
    got = search.search_invoices(docs, query, top=7).collect()
    assert [(r["score"], r["id"]) for r in got] == bm25(TEXTS, query)[:7]


def test_search_filters_keep_the_scores(spark):
    docs = search.search_documents(invoices(spark, TEXTS))
    kept = search.search_invoices(docs, "paper", filters="invoice_number in ('n2', 'n3')").collect()
    assert [(r["score"], r["id"]) for r in kept] == [
        hit for hit in bm25(TEXTS, "paper") if hit[1] == "i2:0"
    ]
    assert search.search_invoices(docs, "paper", filters="user_id is null").count() == 0


def test_keyword_search_shows_a_snippet_but_reads_the_whole_text(spark):
    docs = search.search_documents(invoices(spark, ["x " * 900 + "needle"]))
    (hit,) = search.search_invoices(docs, "needle").collect()
    assert len(hit["content"]) == 500
    assert search.search_invoices(docs, " ,;").count() == 0


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(3)
    stored = [[float(x) for x in v] for v in rng.normal(size=(300, 5))]
    stored[7] = stored[5]
    rows = [(f"c{i:03d}", v) for i, v in enumerate(stored)]
    rows += [("none", None), ("short", [1.0]), ("zero", [0.0] * 5), ("hole", [None] + [1.0] * 4)]
    df = spark.createDataFrame(rows, "id string, content_vector array<float>").repartition(3)
    queries = {f"q{i}": [float(x) for x in v] for i, v in enumerate(rng.normal(size=(600, 5)))}
    queries["same"] = stored[5]
    asked = spark.createDataFrame(list(queries.items()), "query_id string, vector array<double>")

    vectors = np.array(stored, dtype="float32").astype("float64")
    found = {}
    for r in search.vector_topk(df, asked, 6).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for name, q in queries.items():
        cos = vectors @ np.array(q) / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(q))
        best = sorted(zip(-np.round(cos, 6), [r[0] for r in rows], strict=False))[:6]
        got = sorted(found[name])
        assert [g[1] for g in got] == [b[1] for b in best]
        assert [g[2] for g in got] == pytest.approx([-b[0] for b in best])


def test_vector_search_is_one_scan_of_a_bounded_query_set(spark, monkeypatch):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "id string, content_vector array<float>")
    asked = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<double>")
    plan = search.vector_topk(df, asked, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    uneven = asked.unionByName(spark.createDataFrame([("r", [1.0])], asked.schema))
    with pytest.raises(ValueError, match="one width"):
        search.vector_topk(df, uneven, 1)
    monkeypatch.setattr(search, "MAX_QUERY_BYTES", 8)
    with pytest.raises(ValueError, match="several calls"):
        search.vector_topk(df, asked, 1)


def test_read_table_needs_a_version(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none"))
