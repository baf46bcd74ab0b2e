import numpy as np
import pytest

from ledgerloom.llm import decontaminate as dc
from ledgerloom.llm.queries import QUERIES
from tests.conftest import DATA


def plain_edits(item, text):
    """Fewest edits of the item to any substring."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        now = [i + 1]
        for j, e in enumerate(text):
            now.append(min(before[j] + (c != e), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_best_match_equals_the_plain_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, text = (
            bytes(rng.integers(97, 100, int(rng.integers(low, high))).astype(np.uint8))
            for low, high in ((1, 30), (0, 60))
        )
        edits, end = dc.best_match(item, text)
        assert edits == plain_edits(item, text)
        assert edits == plain_edits(item, text[:end])


def _edited(item, n, rng):
    text = bytearray(item)
    for _ in range(n):
        at, kind = int(rng.integers(0, len(text))), rng.integers(0, 3)
        if kind == 0:
            text[at] = int(rng.integers(97, 123))
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, int(rng.integers(97, 123)))
    return bytes(text)


@pytest.fixture(scope="module")
def given_texts():
    import pyarrow.parquet as pq

    read = lambda t: [
        dc.normalised(x) for x in pq.read_table(f"/root/testdata/sf0.01/{t}.parquet")["text"].to_pylist()
    ]
    return read("benchmark"), read("documents")


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1])
def test_recall_of_edited_passages(given_texts, share):
    """Passages with as many edits as allowed, in the middle of documents: recall against the exact
    edit distance is what was aimed at."""
    items, texts = given_texts
    rng, found, wanted = np.random.default_rng(1), 0, 0
    index = dc.Index(items)
    for repeat in range(3):
        planted = []
        for i, item in enumerate(items):
            around = texts[(i + 50 * repeat) % len(texts)]
            passage = _edited(item, int(share * len(item)), rng)
            planted.append(around[:300] + b" " + passage + b" " + around[300:900])
        for i, matches in enumerate(index.search(planted)):
            assert dc.best_match(items[i], planted[i])[0] <= dc.max_edits(len(items[i]))
            wanted += 1
            found += any(m[0] == i for m in matches)
            for item, edits, begin, end in matches:
                assert edits <= dc.max_edits(len(items[item]))
                assert edits == dc.best_match(items[item], planted[i])[0]
                assert dc.best_match(items[item], planted[i][begin:end])[0] == edits
    assert found / wanted >= 0.95


def test_documents_equal_exact_search(spark, given_texts):
    """All pairs of the small tables, against the plain search for every item."""
    docs = {r.doc_id: dc.normalised(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = {r.item_id: dc.normalised(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in QUERIES["op10_decontaminate"](spark, DATA).collect()}
    expected = {(d, i): 0 for d, t in docs.items() for i, x in items.items() if x in t}
    assert expected and {k: got.get(k) for k in expected} == expected
    for (d, i), edits in got.items():
        assert edits == dc.best_match(items[i], docs[d])[0] <= dc.max_edits(len(items[i]))


def test_pieces_lose_no_passage_within_the_bound(given_texts):
    """The window proposals hold every edited passage, whatever the LSH makes of them."""
    items, texts = given_texts
    rng, index = np.random.default_rng(5), dc.Index(given_texts[0])
    for i, item in enumerate(items):
        text = texts[i][:200] + b" " + _edited(item, dc.max_edits(len(item)), rng) + b" " + texts[i][200:500]
        data = np.frombuffer(text + b"\0", np.uint8)
        windows = index._windows(data, np.array([0, len(text) + 1]))
        assert windows is not None and i in windows[1]


def test_blocks_and_odd_items(spark, odd, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1)
    rows = [
        ("a", "the quick brown fox jumps over the lazy dog"), ("b", None), ("c", ""), ("d", "short"),
        ("e", "THE QUICK  brown fox\njumps over the lazy cat"), ("e", "THE QUICK  brown fox\njumps over the lazy cat"),
        (None, "a row without an id"),
    ]
    items = spark.createDataFrame(rows, "item_id string, text string")
    found = dc.contaminated(odd, items).collect()
    pairs = sorted((str(r.doc_id), str(r.item_id), r.edits) for r in found)
    one = [("1", "a", 0), ("1", "e", 3), ("1", "e", 3)]
    assert pairs == sorted(one * 2 + [("2", b, c) for _, b, c in one] + [("None", "None", 0)])
    kept = dc.without_benchmark(odd, items)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "7", "8", "None"]


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(odd, items).count() == 0
    assert dc.without_benchmark(odd, items).count() == odd.count()
    some = spark.createDataFrame([(1, "the quick brown fox jumps")], "item_id long, text string")
    assert dc.contaminated(empty, some).count() == 0


def _edited_within(item, n, low, high, rng):
    part = _edited(item[low:high], n, rng)
    return item[:low] + part + item[high:]


@pytest.mark.parametrize("where", ["front", "front 4t", "front half", "end", "end half", "cut"])
def test_recall_of_passages_edited_in_one_place(given_texts, where):
    """All edits allowed in one part of the passage, or its beginning cut off."""
    items, texts = given_texts
    rng, found, wanted = np.random.default_rng(7), 0, 0
    index = dc.Index(items)
    for repeat in range(3):
        planted = []
        for i, item in enumerate(items):
            n, around = dc.max_edits(len(item)), texts[(i + 50 * repeat) % len(texts)]
            size = len(item)
            passage = {
                "front": lambda: _edited_within(item, n, 0, 2 * n, rng),
                "front 4t": lambda: _edited_within(item, n, 0, 4 * n, rng),
                "front half": lambda: _edited_within(item, n, 0, size // 2, rng),
                "end": lambda: _edited_within(item, n, size - 2 * n, size, rng),
                "end half": lambda: _edited_within(item, n, size // 2, size, rng),
                "cut": lambda: item[n:],
            }[where]()
            planted.append(around[:300] + b" " + passage + b" " + around[300:900])
        for i, matches in enumerate(index.search(planted)):
            assert dc.best_match(items[i], planted[i])[0] <= dc.max_edits(len(items[i]))
            wanted += 1
            found += any(m[0] == i for m in matches)
    assert found / wanted >= 0.95


def test_walks_read_the_whole_item():
    """Strings that differ in their second half only have walks that write something else there."""
    rng = np.random.default_rng(2)
    for size in (100, 1000, 3000):
        head, one, other = (bytes(rng.integers(97, 123, size // 2).astype(np.uint8)) for _ in range(3))
        data = np.frombuffer(head + one + head + other, np.uint8)
        sizes = np.array([size, size])
        keys = dc.Walks(64).keys(data, np.array([0, size]), sizes, sizes)
        assert 0.6 < np.mean((keys[0] != keys[1]).reshape(64, -1).any(axis=1)) < 1


def test_stray_openings_hide_no_exact_copy(given_texts):
    """The first bytes of an item stand once more, some bytes before an exact copy of it."""
    items, texts = given_texts
    index = dc.Index(items)
    for before in (12, 20, 30):
        planted = []
        for i, item in enumerate(items):
            gap = min(before, max(9, dc.max_edits(len(item))))
            planted.append(texts[i][:200] + b" " + item[:8].ljust(gap, b"~") + item + b" " + texts[i][200:500])
        for i, matches in enumerate(index.search(planted)):
            at = planted[i].index(items[i])
            assert (i, 0, at, at + len(items[i])) in matches
            data = np.frombuffer(planted[i] + b"\0", np.uint8)
            _, own, begin = index._windows(data, np.array([0, len(planted[i]) + 1]))
            assert at in begin[own == i].tolist()


def test_short_items_are_searched_exactly():
    """Items of any length, with as many edits as the share allows, against the plain table."""
    rng = np.random.default_rng(4)
    letters = lambda n, high=123: bytes(rng.integers(97, high, n).astype(np.uint8))
    items = [letters(n) for n in (1, 3, 7, 8, 10, 12, 15, 19, 20, 23, 30, 31)] + [letters(n, 99) for n in (2, 11)]
    index = dc.Index(items)
    texts = [letters(400), letters(300, 100), b"", letters(3)]
    for item in items:
        for _ in range(5):
            texts.append(letters(50) + _edited(item, int(0.1 * len(item)), rng) + letters(50))
    for text, matches in zip(texts, index.search(texts)):
        best = {i: plain_edits(x, text) for i, x in enumerate(items)}
        assert {m[0]: m[1] for m in matches} == {i: e for i, e in best.items() if e <= len(items[i]) // 10}
        for i, edits, begin, end in matches:
            assert plain_edits(items[i], text[begin:end]) == edits


def test_items_beyond_the_walks_are_verified_without_keys(monkeypatch):
    """Where the walks allowed fall short of the wanted recall, every dense stretch is verified."""
    rng = np.random.default_rng(12)
    items = [rng.integers(97, 123, 1500, np.uint8).tobytes() for _ in range(6)]
    monkeypatch.setattr(dc, "MAX_WALKS", 8)
    index = dc.Index(items)
    assert index.unsure.all()
    texts = []
    for item in items:
        edited = _edited(item, dc.max_edits(len(item)) // 2, rng)
        around = [rng.integers(97, 123, 700, np.uint8).tobytes() for _ in range(2)]
        texts.append(around[0] + edited + around[1])
    found = index.search(texts)
    assert [{i for i, *_ in matches} for matches in found] == [{n} for n in range(len(items))]
    monkeypatch.setattr(dc, "MAX_WALKS", 512)
    assert not dc.Index([b"a short sentence of a benchmark that many texts hold, word by word " * 2]).unsure.any()


def test_documents_equal_all_pairs(spark):
    """The query on the small tables against the edit distance of every second item to every document."""
    docs = {r.doc_id: dc.normalised(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = {r.item_id: dc.normalised(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    items = {i: x for i, x in items.items() if i % 2 == 0}
    pairs = {(d, i): dc.best_match(x, t)[0] for d, t in docs.items() for i, x in items.items()}
    near = {pair: edits for pair, edits in pairs.items() if edits <= dc.max_edits(len(items[pair[1]]))}
    rows = QUERIES["op10_decontaminate"](spark, DATA).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows if r.item_id in items}
    assert near and set(got) <= set(near) and all(near[pair] == edits for pair, edits in got.items())
    assert len(got) >= dc.TARGET_RECALL * len(near)
