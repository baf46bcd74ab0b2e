import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.scratch import Scratch
from tests.conftest import DATA


def plain_fingerprint(text, n=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    """Smallest reachable key for {key: fingerprint}."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    values = np.array([prints[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance):
            a, b = find(k), find(keys[j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_fingerprint_equals_the_plain_one():
    texts = ["", "one", "One two", "a b c", "a b c d a b c d", "Ä Ö ü", "x\x0by\x1cz q", "w " * 70000]
    for text in texts:
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def _adversarial(blocks, seed=1):
    """Families of fingerprints a few bits apart, many of them inside one block."""
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 1 << 64, 5, dtype=np.uint64).tolist():
        for _ in range(50):
            value = base
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                value ^= 1 << int(bit)
            out.add(value)
        for _ in range(50):
            value, (low, high) = base, simhash._bounds(blocks)[int(rng.integers(0, blocks))]
            for bit in rng.integers(low, high, 3):
                value ^= 1 << int(bit)
            out.add(value)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("distance,blocks,few", [(0, 3, 16), (1, 3, 16), (2, 3, 16), (3, 3, 16), (3, 4, 2)])
def test_links_join_all_close_fingerprints(spark, monkeypatch, distance, blocks, few):
    prints = _adversarial(blocks)
    df = spark.createDataFrame([(int(p.astype(np.int64)),) for p in prints], "fp long")
    meet = simhash._links

    def links(*args):  # in the task, as the tasks do not see the patch
        simhash._FEW = few
        return meet(*args)

    monkeypatch.setattr(simhash, "_links", links)
    found = simhash.links(df, distance, blocks).collect()
    for a, b in found:
        assert (((a ^ b) & (1 << 64) - 1)).bit_count() <= distance
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(found, "a long, b long"), Scratch(spark, "t")).collect()}
    expected = plain_components({int(p.astype(np.int64)): int(p) for p in prints}, distance)
    assert {k: got.get(k, k) for k in expected} == expected


def test_links_across_batches():
    """A run that goes on in the next batch is one run."""
    import pyarrow as pa

    fps = np.arange(8, dtype=np.int64)
    batch = lambda a, b: pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(b - a, np.int64)), pa.array(np.zeros(b - a, np.int32)), pa.array(fps[a:b])],
        ["variant", "block", "fp"],
    )
    rows, simhash._ROWS = simhash._ROWS, 3
    try:
        out = list(simhash._meet(iter([batch(0, 4), batch(4, 8)]), 3, 3))
    finally:
        simhash._ROWS = rows
    nodes = {x for b in out for c in b.columns for x in c.to_pylist()}
    assert nodes == set(range(8))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    rows = {r.node: r.component for r in got.collect()}
    assert rows == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def _plain_roots(edges):
    root = {k: k for edge in edges for k in edge}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


def test_a_long_path_within_a_chunk_takes_two_rounds(spark):
    """Rounds cost hundreds of tasks where shuffles have many partitions."""
    order = np.random.default_rng(3).permutation(3000).tolist()
    edges = list(zip(order, order[1:]))
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), 2)
    assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(3000)}


@pytest.mark.parametrize("chunk", [1, 50])
def test_components_over_many_chunks(spark, chunk):
    rng = np.random.default_rng(4)
    edges = [(int(a) - 300, int(b) - 300) for a, b in rng.integers(0, 600, (350, 2)) if a != b]
    edges += [(-(1 << 63), i) for i in range(1000, 1200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = connected_components(df, Scratch(spark, "t"), chunk=chunk).collect()
    assert {r.node: r.component for r in got} == _plain_roots(edges)
    assert len({r.node for r in got}) == len(got)


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == plain_components(prints, 3)
    assert any(r.component_id != k for k, r in got.items())


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert of[1] == of[2] and len(of[1]) == 1 and {c for _, c in of[1]} == {1}
    # Without words: fingerprint zero, linked, named by the smallest id.
    assert of[3] == of[4] == of[5] == {("0" * 16, 3)}
    assert ("0" * 16, 3) in of[None]
    assert simhash.near_duplicates(empty).count() == 0


def test_representatives_keep_their_columns(odd, empty):
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns
    rows = sorted(((r.doc_id, (r.text or "")[:5]) for r in kept.collect()), key=str)
    # 3 stands for all texts without words, that of a row without an id too.
    assert rows == [(1, "the q"), (3, ""), (6, "ünïcö"), (7, "xxxxx"), (8, "word "), (None, "a row")]
    assert simhash.keep_representatives(empty).count() == 0


def test_rows_of_one_id_with_other_texts_both_stay(spark):
    rows = [(1, "one two three four"), (1, "five six seven eight"), (1, "five six seven eight"), (2, "one two three four")]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "five six seven eight"), (1, "one two three four")]


def test_distance_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)
