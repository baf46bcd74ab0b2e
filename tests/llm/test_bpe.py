import hashlib
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe
from ledgerloom.llm.queries import QUERIES, tokenizer_path
from tests.conftest import DATA
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer(path):
    return Tokenizer.from_file(path)


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_query_equals_the_library(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for r in docs:
        ids = _ids(tokenizer, r.text)
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected[r.doc_id] = (
            len(ids),
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    rows = QUERIES["op7_bpe"](spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == expected


SPECIAL = [
    (10, "don't <|endoftext|>x<|startoftext|> Á ΣΑΣ x y\u0085z \x1c a\x0bb  "),
    (11, "I'LL we've 123 ５ 漢字テスト🙂🙂 é́ ﬁ"),
    (12, "̸ ≠ ≠ a b c"),
    (13, "﻿<|endoftext|> <|ENDOFTEXT|> </w> a</w>"),
]


@pytest.mark.parametrize("chunk_bytes", [1, 64, 1 << 20])
def test_odd_texts_equal_the_library(spark, odd, empty, path, tokenizer, chunk_bytes):
    rows = [*ODD_TEXTS, *SPECIAL]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, path, chunk_bytes=chunk_bytes), path).collect()
    expected = []
    for i, text in rows:
        ids = _ids(tokenizer, text)
        expected.append((str(i), tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in got) == sorted(expected)
    both = bpe.encode(docs, path, chunk_bytes=chunk_bytes, decode_into="again").collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.again) for r in both) == sorted(expected)
    assert bpe.encode(odd, path).count() == odd.count()
    assert bpe.encode(empty, path).collect() == []


def test_packed_numbers_come_back():
    edges = [0, 159, 160, 161, 16543, 16544, 16545, 65535, 65536, bpe._THREE - 1, bpe._THREE, (1 << 32) - 1]
    for values in ([], [5], edges, edges[::-1], list(range(70000))):
        assert bpe._unpack(bpe._pack(values)).tolist() == values


def test_words_are_encoded_once(path, tokenizer, monkeypatch):
    """Parts of several chunks ask the tokenizer once for a word, as long as it is remembered."""
    rows = []
    for chunk, text in enumerate([b"alpha beta beta gamma", b"beta gamma delta", b""]):
        words = {}
        numbers = [words.setdefault(w, len(words)) for w in text.split()]
        rows += bpe._chunk_rows(chunk, words, [np.array(numbers, np.int32)], [chunk], 3)
    asked = []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tokenizer.encode_batch(texts, **options)

    monkeypatch.setattr(bpe, "_tokenizer", lambda _: Spy())
    for remembered, times in ((bpe.REMEMBERED, 1), (1, 2)):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        asked.clear()
        batches = [bpe._batch([r], pa.int64()) for r in sorted(rows, key=lambda r: r[0])]
        out = pa.Table.from_batches(list(bpe._encode(iter(batches), path)))
        assert max(asked.count(w) for w in asked) <= times and set(asked) == {"alpha", "beta", "gamma", "delta"}
        for chunk, text in enumerate(["alpha beta beta gamma", "beta gamma delta", ""]):
            got = bpe._assemble(out.filter(pc.equal(out["chunk"], chunk)), pa.int64())
            assert got["ids"].to_pylist() == [_ids(tokenizer, text)]


def test_decoding_leaves_unknown_ids_out(spark, path, tokenizer):
    ids = [320, 49_999, -1, 1125, 49407]
    rows = spark.createDataFrame([(ids,), ([],), (None,)], "ids array<int>")
    got = [r.decoded for r in bpe.decode(rows, path).collect()]
    assert got == [tokenizer.decode([320, 1125, 49407], skip_special_tokens=False), "", None]


def test_texts_of_all_tasks_spread_over_the_parts(spark):
    rows = [(task << 32, task << 32, [task], None, None) for task in range(256)]
    rows += [(p, 0, None, None, None) for p in range(64)]
    moved = spark.createDataFrame(rows, bpe._moved("bigint"))
    placed = moved.select("docs", "key", bpe._part_of(64).alias("part")).collect()
    texts = [r.part for r in placed if r.docs is not None]
    assert len(set(texts)) > 48 and max(map(texts.count, texts)) < 16
    assert all(r.part == r.key for r in placed if r.docs is None)


_KEEPS = """
import re
import sys
import numpy as np
import pyarrow as pa
from ledgerloom.llm import bpe

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon: +([0-9]+)", f.read())[1]) >> 10

def chunk(n):
    drawn = np.random.default_rng(1).integers(0, 30000, (n, 3000))
    found, texts = np.unique(drawn, return_inverse=True)
    words = {b"w%d" % word: place for place, word in enumerate(found)}
    texts = list(texts.reshape(drawn.shape).astype(np.int32))
    rows = bpe._chunk_rows(0, words, texts, list(range(n)), 64)
    encoded = bpe._encode(iter([bpe._batch(rows, pa.int64())]), sys.argv[1])
    return pa.Table.from_batches(list(encoded)).combine_chunks()

large, small, pieces = chunk(1000), chunk(1), bpe._pieces(sys.argv[1])
before = held()
bpe._decoded(bpe._assemble(large, pa.int64())["ids"].combine_chunks(), pieces)
bpe._assemble(small, pa.int64())
print(held() - before)
"""


def test_a_worker_does_not_keep_the_memory_of_a_chunk(path):
    found = subprocess.run(
        [sys.executable, "-c", _KEEPS, path], capture_output=True, text=True, check=True, timeout=120
    )
    assert int(found.stdout) < 70, found.stdout  # MB
