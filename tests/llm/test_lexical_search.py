import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical_search
from ledgerloom.llm.lexical_search import Segment, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return TERM.findall(lower)


def _ranked(docs, items, top=20):
    """All scores of all documents, by the definition."""
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in _terms(text):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:top], 1):
            rows.append((item, rank, i, -score))
    return rows


def _got(result):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in result.collect()), key=str)


def _random_docs(seed, n, words=40):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = " ".join(f"W{min(int(rng.expovariate(0.15)), words)}" for _ in range(rng.randint(0, 30)))
        docs.append((i, text))
        if rng.random() < 0.3:
            docs.append((rng.randint(0, n), text))  # copies and repeated ids
    return docs, [(k, " ".join(f"w{rng.randint(0, words)}" for _ in range(6))) for k in range(12)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranking_equals_all_scores(spark, seed, monkeypatch):
    docs, items = _random_docs(seed, 250)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert _got(search(frame, asked)) == sorted(_ranked(docs, items), key=str)
    assert _got(search(frame, asked, top=3, item_bytes=30)) == sorted(_ranked(docs, items, 3), key=str)


@pytest.mark.parametrize("postings", [1, 50, 1 << 18])
def test_segments_do_not_change_the_ranking(postings, monkeypatch):
    """A partition searched whole and in small segments, without Spark."""
    docs, items = _random_docs(9, 120)
    frame = __import__("pyarrow").table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    numbers = {t: n for n, t in enumerate(sorted({t for _, x in items for t in terms_of(x.encode())}))}
    shared = type("Shared", (), {})
    vocabulary, queries = shared(), shared()
    vocabulary.value = numbers
    batches = list(lexical_search._postings(frame.to_batches(max_chunksize=7), vocabulary))
    counted = [c for _, c in ((i, Counter(_terms(t))) for i, t in docs) if c]
    df = Counter(t for c in counted for t in c)
    weights = {
        n: math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t.decode()] + 1)))
        for t, n in numbers.items() if df[t.decode()]
    }
    texts = [x.encode() for _, x in items]
    queries.value = (
        lexical_search.Queries(texts, weights, numbers), len(numbers), len(counted),
        sum(sum(c.values()) for c in counted),
    )
    monkeypatch.setattr(lexical_search, "SEGMENT_POSTINGS", postings)
    (out,) = lexical_search._search(iter(batches), queries, 20)
    got = defaultdict(list)
    for row in out.to_pylist():
        got[row["query"]].append((-row["score"], row["doc_id"]))
    expected = defaultdict(list)
    for item, _, i, score in _ranked(docs, items):
        expected[item].append((-score, i))
    assert {q: sorted(x) for q, x in got.items()} == dict(expected)


def test_largest_equals_the_maximum_of_the_stretch():
    rng = np.random.default_rng(4)
    n = 300
    segment = Segment(
        np.arange(n), np.ones(n, np.int64), np.arange(n), np.zeros(n, np.int32),
        rng.integers(1, 6, n), 1, n, n,
    )
    lo = rng.integers(0, n + 1, 2000)
    hi = np.maximum(lo, rng.integers(0, n + 1, 2000))
    impact, place = segment.largest(lo, hi)
    for a, b, x, p in zip(lo, hi, impact, place):
        part = segment.impacts[a:b]
        assert x == (part.max() if len(part) else 0)
        if len(part):
            assert p == a + part.argmax()


def test_few_documents_are_scored():
    """Where one document stands out, the others are left alone."""
    n, scored = 5000, []
    rng = np.random.default_rng(5)
    owner = np.concatenate([np.arange(n), rng.choice(n, 60, replace=False)])
    terms = np.concatenate([np.zeros(n, np.int32), np.ones(60, np.int32)])
    segment = Segment(np.arange(n), np.full(n, 50), owner, terms, np.ones(n + 60, np.int64), 2, n, 50 * n)
    queries = lexical_search.Queries([b"common rare"], {0: 1, 1: 9000}, {b"common": 0, b"rare": 1})
    split = lexical_search._split
    best = [[]]
    try:
        lexical_search._split = lambda popped, *rest: (scored.extend(popped), split(popped, *rest))
        lexical_search._search_segment(segment, queries, best, 20)
    finally:
        lexical_search._split = split
    assert len(best[0]) == 20 and len(scored) < 200
    rare = sorted(owner[n:].tolist())
    assert sorted(-i for _, i in best[0]) == rare[:20]


def test_odd_rows(spark, odd, empty):
    docs = odd.withColumns({c: F.lit(1) for c in ("query", "terms", "counts", "rank", "n")})
    items = [(1, "Brown fox!"), (1, "Brown fox!"), (2, ""), (3, None), (None, "漢字 word id"), (4, "nowhere")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    expected = _ranked(plain, [i for i in items if i[1]])
    assert _got(search(docs, asked)) == sorted(expected, key=str) and expected
    assert search(empty, asked).collect() == []
    assert search(docs, asked.limit(0)).collect() == []
    with pytest.raises(TypeError):
        search(docs.withColumn("doc_id", F.lit("x")), asked)
