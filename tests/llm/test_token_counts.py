import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from ledgerloom.llm import token_counts as tc
from ledgerloom.llm.queries import QUERIES, tokenizer_path
from tests.conftest import DATA

NORMALIZER = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])


def library(pieces, by_bytes):
    model = Tokenizer(models.Unigram([(p, float(s)) for p, s in pieces], unk_id=0, byte_fallback=by_bytes))
    model.normalizer = NORMALIZER
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pieces():
    return tc.read_pieces(tokenizer_path("piece_bpe_32k.model"))


def test_query_equals_the_library(spark, pieces):
    count = library(pieces, True)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op9_token_counts"](spark, DATA).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: count(t) for i, t in docs.items()}


def test_odd_texts_equal_the_library(pieces):
    vocabulary, count = tc.Vocabulary(pieces), library(pieces, True)
    texts = [
        "", " ", "  a  b ", "   ", "x\ny", "漢字🙂 ▁ a▁b <s> <0x0A>", "aaaa" * 50, "\t\t z", "é" * 20,
        "a " * 5, "\x00", "word" * 3000,
    ]
    for text in texts:
        assert vocabulary.count(text)[1] == count(text), text


SMALL = [
    ("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0),
    ("▁a", -2.0), ("bb", -1.0),
]


@pytest.mark.parametrize("extra", [[], [("b▁a", -1.0)], [("c▁", -0.5)]])
def test_ties_and_unknown_runs_equal_the_library(extra):
    """Equal sums everywhere; also vocabularies with pieces that go on after a space."""
    pieces = SMALL + extra
    vocabulary, count, rng = tc.Vocabulary(pieces), library(pieces, False), random.Random(1)
    assert vocabulary.cut_at_spaces == (not extra)
    for _ in range(1500):
        text = "".join(rng.choice("ab cd") for _ in range(rng.randint(1, 12)))
        assert vocabulary.count(text)[1] == count(text), text


def test_memory_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 10)
    vocabulary, count = tc.Vocabulary(pieces), library(pieces, True)
    text = " ".join(f"word{i}" for i in range(200))
    assert vocabulary.count(text)[1] == count(text)
    assert len(vocabulary.memory) <= 10


def test_odd_rows(odd, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = tc.count_tokens(odd, path).collect()
    assert len(rows) == odd.count()
    assert {(r.n_tokens, r.score) for r in rows if r.doc_id in (3, 4)} == {(0, 0.0)}
    assert len({(r.n_tokens, r.score) for r in rows if r.doc_id in (1, 2)}) == 1
    assert tc.count_tokens(empty, path).count() == 0
