"""Ids of texts, a batch at a time, from the pieces that the tokenizer's own pre-tokenizer cuts words into.

Words of a corpus share far fewer pieces (runs of letters, single digits, runs of marks) than they are
themselves, and a piece goes straight to the model. Arrow cuts the distinct words of a batch; only its
distinct pieces are looked at one by one. Words are cut here if they are of characters for which that is
known to give the same; all others, and all words of a tokenizer that cuts in another way, are encoded whole.
"""

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.bpe import _tokenizer

_TOGETHER = 1 << 18  # words whose ids are put together at once

# The normalizers and pre-tokenizers of the vocabulary whose cuts `_PIECE` restates.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
# Printable ASCII and the letters of Latin-1: all are composed, and lower case is one letter of these.
_ASCII = [chr(c) for c in range(0x21, 0x7F)]
_LETTERS = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
_LETTER_BYTES = r"\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]"
# `_CUT` for lower-cased words of these characters.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"


def _byte_level():
    """The characters that stand for the bytes of a letter beyond ASCII."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    shown = [chr(b if b in plain else next(others)) for b in range(256)]
    return str.maketrans({c: "".join(shown[b] for b in c.encode()) for c in _LETTERS})


_SHOWN = _byte_level()


def _known_words(tokenizer):
    """The pattern, of bytes, of words that may be cut here; none if the tokenizer cuts in another way."""
    rules = json.loads(tokenizer.to_str())
    normalizer, cutter = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    steps = [
        {k: v for k, v in step.items() if k != "trim_offsets"} for step in cutter.get("pretokenizers", [])
    ]
    if normalizer.get("normalizers") != _NORMALIZERS or steps != [_SPLIT, _BYTES]:
        return None
    if rules["model"]["type"] != "BPE" or rules["model"].get("dropout"):
        return None
    # Added tokens are found before a word is cut.
    begin = {c for t in rules["added_tokens"] for x in t["content"][:1] for c in (x, x.lower(), x.upper())}
    if not begin <= set(_ASCII):
        return None
    allowed = "".join(rf"\x{ord(c):02X}" for c in _ASCII if c not in begin)
    return f"^(?:[{allowed}]|{_LETTER_BYTES})+$"


def _gather(values, begin, count, own):
    """The values of each of some stretches, one after the other, and the stretches' sizes."""
    size = count[own]
    shift = np.repeat(begin[own] - (np.cumsum(size) - size), size)
    return values[shift + np.arange(len(shift))], size


def _ends(sizes):
    """Where stretches of these sizes begin, and where the last one ends."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _lengths(lists):
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


class TextIds:
    """Ids of texts, little-endian in `width` bytes each. Ids of up to twice `limit` pieces and whole words
    are remembered: when `limit` have been asked for, those that were not asked for since the last time
    are forgotten, so frequent ones stay."""

    def __init__(self, path, width, limit):
        self.tokenizer, self.kind, self.limit = _tokenizer(path), np.dtype(f"<u{width}"), limit
        self.pattern = _known_words(self.tokenizer)
        self.model = self.tokenizer.model
        self.ids, self.older = {}, {}

    def _made(self, new):
        """Ids, as bytes, of pieces (str) or of whole words (bytes)."""
        if new and isinstance(new[0], str):
            tokenize = self.model.tokenize
            shown = [p if p.isascii() else p.translate(_SHOWN) for p in new]
            found = [[t.id for t in tokenize(p)] if p else [] for p in shown]
        else:
            texts = [w.decode("utf-8", "replace") for w in new]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size, flat = self.kind.itemsize, np.array([i for ids in found for i in ids], self.kind).tobytes()
        ends = _ends(np.fromiter(map(len, found), np.int64, len(found))).tolist()
        return [flat[a * size : b * size] for a, b in zip(ends, ends[1:])]

    def _remembered(self, names):
        """(ids, begin, count) of distinct pieces or whole words."""
        ids, older = self.ids, self.older
        found = {x: ids.get(x) or older.get(x) for x in names}
        new = [x for x, one in found.items() if not one]
        found.update(zip(new, self._made(new)))
        for x, one in found.items():
            if len(self.ids) >= self.limit:
                self.ids, self.older = {}, self.ids
            self.ids[x] = one
        count = np.fromiter(map(len, found.values()), np.int64, len(found)) // self.kind.itemsize
        return np.frombuffer(b"".join(found.values()), self.kind), np.cumsum(count) - count, count

    def _words(self, words):
        """(ids, begin, count) of distinct words."""
        if self.pattern is None:
            return self._remembered(words.to_pylist())
        known = pc.match_substring_regex(words, self.pattern)
        texts = pc.utf8_lower(words.filter(known).cast(pa.string()))
        cut = pc.split_pattern(pc.replace_substring_regex(texts, _PIECE, r"\1 "), " ")
        pieces = cut.flatten().dictionary_encode()
        own, number = pieces.indices.to_numpy(), _lengths(cut)
        flat, size = _gather(*self._remembered(pieces.dictionary.to_pylist()), own)
        per_word = np.diff(_ends(size)[_ends(number)])
        whole, whole_begin, whole_count = self._remembered(words.filter(pc.invert(known)).to_pylist())
        known = known.to_numpy(zero_copy_only=False)
        begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[known], count[known] = np.cumsum(per_word) - per_word, per_word
        begin[~known], count[~known] = len(flat) + whole_begin, whole_count
        return np.concatenate([flat, whole]), begin, count

    def of(self, texts):
        """Yield the ids of each of a column of texts (UTF-8 bytes; null: none)."""
        # Cutting at ASCII white space looks at bytes only, so bytes that are no UTF-8 may stay.
        large = pa.types.is_large_binary(texts.type)
        lists = pc.ascii_split_whitespace(
            pc.fill_null(texts, b"").view(pa.large_string() if large else pa.string())
        )
        words = lists.flatten().view(texts.type).dictionary_encode()
        made, own = self._words(words.dictionary), words.indices.to_numpy()
        parts = [_gather(*made, own[a : a + _TOGETHER]) for a in range(0, len(own), _TOGETHER)]
        ids = np.concatenate([np.empty(0, self.kind), *(x for x, _ in parts)])
        sizes = np.concatenate([np.empty(0, np.int64), *(x for _, x in parts)])
        ends = _ends(sizes)[_ends(_lengths(lists))].tolist()
        for a, b in zip(ends, ends[1:]):
            yield ids[a:b].tobytes()


@lru_cache(maxsize=1)
def text_ids(path, width, limit):
    """One for all tasks that a Python worker runs."""
    return TextIds(path, width, limit)
