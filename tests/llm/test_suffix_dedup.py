import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import suffix_array, suffix_dedup
from ledgerloom.llm.queries import QUERIES
from tests.conftest import DATA


def test_suffix_arrays_and_prefixes_equal_the_plain_ones():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n, letters = int(rng.integers(0, 160)), int(rng.integers(1, 5))
        data = (rng.integers(0, letters, n) + (0 if trial % 2 else 97)).astype(np.uint8)
        if trial % 7 == 0:
            data = np.tile(data[: max(1, n // 5)], 6)
        text = data.tobytes()
        order = suffix_array.suffix_array(data)
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
        shared = suffix_array.common_prefixes(data, order)
        for r in range(1, len(text)):
            a, b, m = text[order[r - 1] :], text[order[r] :], 0
            while m < min(len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert shared[r] == m


def plain_removal(docs, length=100):
    """{key: (bytes, removed, spans, digest)} for (key, bytes) in the order of their start."""
    seen, out = set(), {}
    for key, data in docs:
        mark = bytearray(len(data))
        for i in range(len(data) - length + 1):
            h = hashlib.blake2b(data[i : i + length], digest_size=12).digest()
            if h in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(h)
        kept = bytes(c for c, m in zip(data, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[key] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def _result(left):
    size = F.octet_length("text")
    rows = left.select(
        "doc_id", size.alias("n"), (size - F.octet_length("kept")).alias("r"),
        F.size("spans").alias("s"), F.sha2("kept", 256).alias("k"),
    )
    return [(r.doc_id, (r.n, r.r, r.s, r.k)) for r in rows.collect()]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    expected = plain_removal(sorted((r.doc_id, r.text.encode()) for r in docs))
    rows = QUERIES["op8_suffix_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected
    assert any(v[1] for v in expected.values())


def _passages(seed):
    """Texts of shared passages, periodic stretches and noise."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcd ") for _ in range(rng.randint(60, 260))) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                passage = rng.choice(shared)
                parts.append(passage[rng.randint(0, 30) :] if rng.random() < 0.5 else passage)
            elif kind < 0.7:
                parts.append(rng.choice(["a", "ab", "xyz ", "q" * 7]) * rng.randint(1, 150))
            else:
                parts.append("".join(rng.choice("efgh \0") for _ in range(rng.randint(0, 200))))
        docs.append((i, "é".join(parts)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(
    "options", [{}, {"hot_blocks": 3}, {"shard_bytes": 500}, {"hot_blocks": 10, "shard_bytes": 300}]
)
def test_shared_and_periodic_passages(spark, on_files, options):
    docs = _passages(3)
    expected = plain_removal(sorted((i, t.encode()) for i, t in docs))
    df = on_files(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert dict(_result(suffix_dedup.remove_repeats(df, **options))) == expected


def test_long_texts_are_cut_in_stretches(spark, monkeypatch):
    """Blocks cut at a stretch's end still hold every string once."""
    text = ("abc" * 70 + "0123456789" * 30 + "xyz" * 50).encode() * 3
    whole = suffix_dedup._blocks(text, 100)
    monkeypatch.setattr(suffix_dedup, "_SLAB", 97)
    cut = suffix_dedup._blocks(text, 100)
    strings = lambda b: [i for f, c in zip(b[1], b[2]) for i in range(f, f + c)]
    assert strings(whole) == strings(cut) == list(range(len(text) - 99))


def test_odd_rows(spark, odd, empty):
    rows = _result(suffix_dedup.remove_repeats(odd))
    assert len(rows) == odd.count()
    assert {v[:3] for i, v in rows if i in (3, 4)} == {(0, 0, 0)}
    eight = dict(rows)[8]
    assert eight[0] == 150_000 and eight[1] == 150_000 - 5 and eight[2] == 1
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, "x" * 150), (3, "x" * 150), (3, "x" * 150), (3, "y" + "x" * 140), (4, "z" * 99)]
    got = _result(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    figures = sorted(((i, v[:3]) for i, v in got), key=str)
    assert figures == [
        (3, (141, 140, 1)), (3, (150, 150, 1)), (3, (150, 150, 1)), (4, (99, 0, 0)), (None, (150, 149, 1)),
    ]
