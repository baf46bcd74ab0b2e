import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.word_ids import TextIds

ODD = [
    "the Straße's CAFÉ, naïve!! don't we'LL 2024 x2y ''s 'S''t", "ÀÖØÞßàöøÿ ×÷ µ ª º ½ ²",
    "e\u0301e a\u0308. İstanbul ΣΑΣ Kelvin\u212a ŉ ſs ÿŸ", "a\u00a0b c\x85d e\x1cf g\x0bh\x0ci \u2028j\x00k\x7f",
    "漢字 🙂🙂 кириллица हिन्दी", "in<|endoftext|>side <|startoftext|> <| < |> a<b", " lead  and trail \n", "", " \t\n ",
]


def _found(ids, texts, kind=pa.binary()):
    column = pa.array([t.encode() if isinstance(t, str) else t for t in texts], kind)
    return [np.frombuffer(x, ids.kind).tolist() for x in ids.of(column)]


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
@pytest.mark.parametrize("limit", [1, 1000])
def test_ids_are_the_librarys(limit, kind):
    own, ids = Tokenizer.from_file(tokenizer_path()), TextIds(tokenizer_path(), 2, limit)
    draw, letters = random.Random(5), sorted({c for t in ODD for c in t} | {chr(c) for c in range(256)})
    texts = ODD + ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(2000)]
    wanted = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert _found(ids, texts, kind) == wanted
    assert _found(ids, texts[::-1], kind) == wanted[::-1]
    assert len(ids.ids) <= limit and len(ids.older) <= limit
    assert _found(ids, [None, "", None], kind) == [[], [], []] and _found(ids, [], kind) == []


def test_bytes_that_are_no_text():
    own, ids = Tokenizer.from_file(tokenizer_path()), TextIds(tokenizer_path(), 2, 100)
    data = [b"a\xff b\xc3 \xe9t\xe9 ok", b"\xc3\x97 \xc3\x9f"]
    assert _found(ids, data) == [own.encode(x.decode("utf-8", "replace")).ids for x in data]


def test_a_piece_is_made_once_whatever_words_it_stands_in(monkeypatch):
    ids, made = TextIds(tokenizer_path(), 2, 100), []
    one = TextIds._made
    monkeypatch.setattr(TextIds, "_made", lambda self, new: made.extend(new) or one(self, new))
    _found(ids, ["Word word, (WORD) word's"])
    _found(ids, ["word... word, other"])
    assert sorted(x for x in made if x) == sorted(["word", ",", "(", ")", "'s", "...", "other"])


def test_a_tokenizer_that_cuts_in_another_way_gets_whole_words(tmp_path):
    names = [chr(c) for c in range(33, 127)] + ["ab", "b!"]
    own = Tokenizer(models.BPE({x: i for i, x in enumerate(names)}, [("a", "b"), ("b", "!")]))
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own.save(str(tmp_path / "own.json"))
    ids, texts = TextIds(str(tmp_path / "own.json"), 4, 100), ["ab! AB b!\tb", None, "ab"]
    assert ids.pattern is None
    assert _found(ids, texts) == [own.encode(t or "").ids for t in texts]
