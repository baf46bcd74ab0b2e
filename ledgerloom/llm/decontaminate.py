"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification.

The random walk of Chakraborty, Goldenberg and Koucky reads a string with a shared random table: at
each step it writes the character it stands on and moves on or stays, as the table says for the step
and the character. Strings a few edits apart fall into step again, so that edit distance becomes
Hamming distance of the written strings. A key is the characters written at a few sampled steps;
several walks with other tables give several keys, as many as the target recall needs. A window of an
item's size that shares a key with the item is verified by the exact edit distance.

Which windows are embedded, and for which item: an item of L bytes is cut in pieces of 8 bytes. A
passage at most t edits away holds all but t of them unchanged, on offsets at most 2t apart. Places
without that many pieces of an item cannot be such a passage and are left out; nothing else is. Items
with no more than t pieces are cut in t + 1 shorter ones and verified wherever one of them stands.

The benchmark is the query set and travels to the tasks in blocks of bounded size; documents are read
where they lie, once for each block, and nothing is shuffled.
"""

import sys
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import small_batches

MAX_EDITS = 0.1  # of an item's bytes
TARGET_RECALL = 0.97
SAMPLED = 3  # characters in a key
PERIOD = 512  # steps after which a walk's tables come again, turned by some characters
MAX_WALKS = 512  # items for which more would be needed have all of their dense stretches verified
PIECE = 8
BLOCK_BYTES = 8 << 20  # of benchmark text that a task holds at once
_SLAB = 2 << 20  # bytes of documents that are looked at together
_FILTER_BITS = 22
_CELLS = 1 << 14  # strings times walks that are walked together
_BYTES = 1 << 20  # of strings that are walked together
_TIDIED = 16  # steps after which walks that have ended are put aside
_END = 256  # what a walk writes behind the end
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    """Lower case, one blank between words, UTF-8: what is compared."""
    return " ".join(text.lower().split()).encode("utf-8", "replace") if text else b""


def _steps(length):
    """Steps of a walk: half of them move on, so that it reads the whole item."""
    return 2 * length


class Walks:
    """Random tables and sampled steps, the same in all tasks."""

    def __init__(self, n: int, seed: int = 5):
        self.n = n
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (PERIOD, n, _END + 1), np.uint8)
        self.sampled = np.sort(rng.random((n, SAMPLED)), axis=1)  # as shares of the walk

    def _table(self, step, walks):
        lap, step = divmod(step, PERIOD)
        table = self.moves[step, walks]
        return (np.roll(table, 31 * lap, axis=1) if lap else table).ravel()

    def keys(self, data, begin, length, size, walks=slice(None), wanted=None):
        """The characters that each walk of an item of `size` bytes writes on each string (begin, length)
        at its sampled steps. With the `wanted` ones, a walk ends where it writes another one."""
        sampled = (self.sampled[walks] * _steps(size)[:, None, None]).astype(np.int64)
        rows, n = sampled.shape[:2]
        out = np.full((rows, n, SAMPLED), -1, np.int16)
        if not out.size:
            return out
        # The strings side by side, with as many ends behind them as a walk can read.
        width = int(_steps(size.max())) + 1
        place = np.arange(width)
        strings = data[np.minimum(begin[:, None] + place, len(data) - 1)].astype(np.int16)
        strings[place >= length[:, None]] = _END
        strings, written = strings.ravel(), out.ravel()
        expected = None if wanted is None else wanted.ravel()
        events = np.argsort(sampled, axis=None, kind="stable")
        writes = sampled.ravel()[events]
        cuts = np.searchsorted(writes, np.arange(writes[-1] + 2)).tolist()
        # One cell for each walk of each string, as long as it goes on.
        at, base = np.repeat(np.arange(rows) * width, n), np.tile(np.arange(n) * (_END + 1), rows)
        cell, due = np.arange(rows * n), sampled[..., -1].ravel()
        where, goes = cell.copy(), np.ones(rows * n, bool)
        for step in range(len(cuts) - 1):
            if step % _TIDIED == _TIDIED - 1:
                goes &= due[cell] >= step
                at, base, cell = at[goes], base[goes], cell[goes]
                where[:] = -1
                where[cell], goes = np.arange(len(cell)), np.ones(len(cell), bool)
                if not len(cell):
                    break
            c = strings.take(at)
            if cuts[step] < cuts[step + 1]:
                hit = events[cuts[step] : cuts[step + 1]]
                now = where[hit // SAMPLED]
                hit, now = hit[now >= 0], now[now >= 0]
                written[hit] = c[now]
                if expected is not None:
                    goes[now[c[now] != expected[hit]]] = False
            at += self._table(step, walks).take(c + base)
        return out


def best_match(item: bytes, text: bytes):
    """(edits, end) of the substring of the text with the fewest edits to the item; the first end.

    Myers' bit-parallel dynamic programme; rows are bits of one integer.
    """
    m = len(item)
    where = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, (m, 0)
    for i, c in enumerate(text):
        eq = where[c] if c in where else 0
        x = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & mask)
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = down | (~(x | up) & mask), up & x
        if score < best[0]:
            best = (score, i + 1)
    return best


def max_edits(length: int, share: float = MAX_EDITS) -> int:
    """Edits allowed for an item: a share of its bytes, and fewer than all of them."""
    return max(0, min(int(share * length), length - 1))


def _with_edits(item, n, where, rng):
    """The item with n random edits, and where its window begins as seen from its edited beginning."""
    text = bytearray(item)
    if where == "cut":
        return bytes(text[n:]), -n
    low, high = {"spread": (0, len(item)), "front": (0, 2 * n), "end": (len(item) - 2 * n, len(item))}[where]
    for _ in range(n):
        at, kind = int(rng.integers(min(low, len(text) - 1), max(1, min(high, len(text))))), rng.integers(0, 3)
        if kind == 0:
            text[at] = int(rng.integers(97, 123))
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, int(rng.integers(97, 123)))
    return bytes(text), len(text) - len(item) if where == "front" else 0


def _batches(rows, walks, longest):
    """The rows, as many at a time as are walked together."""
    together = max(1, min(_CELLS // max(1, walks), _BYTES // max(1, longest)))
    return (rows[first : first + together] for first in range(0, len(rows), together))


@dataclass
class Index:
    """The items of one block, ready for search. Items with no more pieces than edits are searched exactly,
    by shorter pieces of their own; the others by windows and walks."""

    items: list[bytes]
    share: float = MAX_EDITS
    recall: float = TARGET_RECALL

    def __post_init__(self):
        items = self.items
        sizes = np.array([len(x) for x in items], np.int64)
        self.sizes = sizes
        self.edits = np.array([max_edits(n, self.share) for n in sizes], np.int64)
        self.long = sizes // PIECE > self.edits
        pieces = [
            (x[o : o + PIECE], i, o)
            for i, x in enumerate(items)
            if self.long[i]
            for o in range(0, len(x) - PIECE + 1, PIECE)
        ]
        keys = np.array([int.from_bytes(p[0], sys.byteorder) for p in pieces], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.piece_item = np.array([p[1] for p in pieces], np.int64)[order]
        self.piece_offset = np.array([p[2] for p in pieces], np.int64)[order]
        self.needed = np.maximum(sizes // PIECE - self.edits, 1)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.keys)] = True
        self.walks = Walks(self._walks_needed())
        self.item_keys = self._keys_of_items()

    @staticmethod
    def _slot(keys):
        return (keys * _MULTIPLIER) >> np.uint64(64 - _FILTER_BITS)

    def _walks_needed(self):
        """Walks that reach the target recall for items with as many random edits as are allowed, be they
        spread, all at the front or all at the end: the most that one of these cases needs. Where
        `MAX_WALKS` fall short of it, `unsure` marks the items of the lengths (by powers of two) that do;
        no key is asked of their stretches."""
        rng = np.random.default_rng(3)
        trial = Walks(96, seed=4)
        usable = np.flatnonzero(self.long)
        tried = usable[rng.permutation(len(usable))[:96]].tolist()
        self.unsure = np.zeros(len(self.items), bool)
        needed, cases = 8, []
        for where in ("spread", "front", "end", "cut") if tried else ():
            data, begin, length, size = b"", [], [], []
            for i in tried:
                item = self.items[i]
                text, shift = _with_edits(item, int(self.edits[i]), where, rng)
                begin += [len(data), len(data) + len(item) + shift]
                # An unchanged piece behind the front gives the window; what lies around it is foreign.
                around = rng.integers(97, 123, 2 * len(item), np.uint8).tobytes()
                data += item + around[: len(item)] + text + around[len(item) :]
                begin[-1] += len(item)
                length += [len(item)] * 2
                size += [len(item)] * 2
            keys = trial.keys(np.frombuffer(data, np.uint8), *map(np.array, (begin, length, size)))
            rates = np.mean((keys[::2] == keys[1::2]).all(axis=2), axis=1)
            rates = np.maximum(rates, 0.5 / trial.n)  # none of the walks tried does not mean none
            cases.append(rates)
            while needed < MAX_WALKS and np.mean(1 - (1 - rates) ** needed) < self.recall:
                needed += 8
        reached = np.min([1 - (1 - rates) ** needed for rates in cases], axis=0) if cases else np.ones(0)
        if len(reached) and reached.mean() < self.recall and needed >= MAX_WALKS:
            kind = np.log2(np.maximum(self.sizes, 1)).astype(int)
            for k in np.unique(kind[usable]):
                own = reached[kind[tried] == k]
                if not len(own) or own.mean() < self.recall:
                    self.unsure |= self.long & (kind == k)
        return needed

    def _keys_of_items(self):
        out = np.zeros((len(self.items), self.walks.n, SAMPLED), np.int16)
        data = np.frombuffer(b"".join(self.items) + b"\0", np.uint8)
        begin = np.cumsum(self.sizes) - self.sizes
        for own in _batches(np.flatnonzero(self.long), self.walks.n, self.sizes.max(initial=0)):
            size = self.sizes[own]
            out[own] = self.walks.keys(data, begin[own], size, size)
        return out

    def _hits(self, data):
        """(position, item, offset) of all pieces in the bytes."""
        if len(data) < PIECE or not len(self.keys):
            return None
        grams = np.ndarray((len(data) - PIECE + 1,), np.uint64, data, strides=(1,))
        at = np.flatnonzero(self.filter[self._slot(grams)])
        found = grams[at]
        left = np.searchsorted(self.keys, found, "left")
        count = np.searchsorted(self.keys, found, "right") - left
        total = int(count.sum())
        if not total:
            return None
        piece = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(total)
        return np.repeat(at, count), self.piece_item[piece], self.piece_offset[piece]

    def _windows(self, data, starts):
        """(text, item, begin) of the windows to embed; texts begin at `starts` in the bytes."""
        hits = self._hits(data)
        if hits is None:
            return None
        position, item, offset = hits
        text = np.searchsorted(starts, position, "right") - 1
        begin = position - offset
        order = np.lexsort((begin, item, text))
        text, item, begin, offset = text[order], item[order], begin[order], offset[order]
        # As many pieces as needed lie between a hit and the one `needed - 1` further on.
        reach = np.arange(len(begin)) + self.needed[item] - 1
        inside = reach < len(begin)
        end = np.minimum(reach, len(begin) - 1)
        dense = inside & (text[end] == text) & (item[end] == item)
        dense &= begin[end] - begin <= 2 * self.edits[item]
        if not dense.any():
            return None
        # Every hit of a dense stretch proposes its own beginning; equal ones are one.
        cover = np.zeros(len(begin) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(dense), 1)
        np.add.at(cover, reach[dense] + 1, -1)
        chosen = np.cumsum(cover[:-1]) > 0
        return tuple(np.unique(np.stack([text[chosen], item[chosen], begin[chosen]]), axis=1))

    def _collided(self, data, text, item, begin, starts, stretch, n):
        """Which of the n stretches share a key with their item. A stretch is embedded at all of its
        beginnings, with more and more walks until one of them collides."""
        begin = np.maximum(begin, starts[text])
        size = self.sizes[item]
        length = np.minimum(size, starts[text + 1] - 1 - begin)
        out, open_, first, more = np.zeros(n, bool), np.arange(len(item)), 0, 4
        out[stretch[self.unsure[item]]] = True
        by_size = np.argsort(-size, kind="stable")
        while first < self.walks.n and len(open_):
            walks = slice(first, min(first + more, self.walks.n))
            open_ = by_size[~out[stretch[by_size]]]
            for part in _batches(open_, walks.stop - first, self.sizes.max()):
                wanted = self.item_keys[item[part], walks]
                keys = self.walks.keys(data, begin[part], length[part], size[part], walks, wanted)
                same = (keys == wanted).all(axis=2).any(axis=1)
                out[stretch[part[same]]] = True
            first, more = walks.stop, 2 * more
        return out

    def _stretches(self, data, starts):
        """(text, item, first and last beginning) of the stretches that share a key with their item."""
        windows = self._windows(data, starts)
        if windows is None:
            return
        text, item, begin = windows
        # Windows of one passage begin at most 2t apart; a stretch of them is verified as a whole.
        pad = 2 * self.edits[item] + 1
        new = np.ones(len(item), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(begin) > pad[1:])
        stretch, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        tails = np.append(heads[1:], len(item)) - 1
        collided = self._collided(data, text, item, begin, starts, stretch, len(heads))
        yield from zip(*(x[collided].tolist() for x in (text[heads], item[heads], begin[heads], begin[tails])))

    def _stretches_of_short(self, blob, starts):
        """The same for the items that are searched exactly: wherever one of t + 1 pieces stands, as t
        edits cannot touch all of them."""
        for i in np.flatnonzero(~self.long & (self.sizes > 0)).tolist():
            item, t = self.items[i], int(self.edits[i])
            size, found = len(item) // (t + 1), set()
            for offset in range(0, size * (t + 1), size):
                piece = item[offset : offset + size] if t else item
                at = blob.find(piece)
                while at >= 0:
                    text = int(np.searchsorted(starts, at, "right")) - 1
                    found.add((text, at - offset))
                    # Without edits the first place in a text is the best one.
                    at = blob.find(piece, at + 1 if t else int(starts[text + 1]))
            head = last = None
            for text, begin in sorted(found):
                if head and (head[0] != text or begin - last > 2 * t + 1):
                    yield head[0], i, head[1], last
                    head = None
                head, last = head or (text, begin), begin
            if head:
                yield head[0], i, head[1], last

    def search(self, texts: list[bytes]):
        """For each text its matches (item, edits, begin, end), the best one of each item."""
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        blob = b"\0".join([*texts, b""])
        data = np.frombuffer(blob, np.uint8)
        out = [[] for _ in texts]
        best = {}
        for t, i, low, high in [*self._stretches(data, starts), *self._stretches_of_short(blob, starts)]:
            pad = 2 * int(self.edits[i]) + 1
            a = max(int(starts[t]), low - pad)
            b = min(int(starts[t + 1]) - 1, high + int(self.sizes[i]) + pad)
            edits, end = best_match(self.items[i], data[a:b].tobytes())
            if edits <= self.edits[i] and (edits, a + end) < best.get((t, i), (1 << 60, 0)):
                best[t, i] = (edits, a + end)
        for (t, i), (edits, end) in sorted(best.items()):
            # The same search backwards from the end gives the beginning.
            a = max(int(starts[t]), end - int(self.sizes[i]) - edits)
            _, size = best_match(self.items[i][::-1], data[a:end].tobytes()[::-1])
            out[t].append((i, edits, end - size - int(starts[t]), end - int(starts[t])))
        return out


def _searched(text: Column, index) -> Column:
    """Array of matches in a text column; `index` is a broadcast of an `Index`."""

    @F.arrow_udf("array<struct<item: int, edits: int, begin: bigint, `end`: bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        own, out, slab, size = index.value, [], [], 0
        for value in texts:
            data = normalised(value.as_py())
            slab.append(data)
            size += len(data)
            if size >= _SLAB:
                out += own.search(slab)
                slab, size = [], 0
        if slab:
            out += own.search(slab)
        kind = pa.struct(
            [("item", pa.int32()), ("edits", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]
        )
        names = ["item", "edits", "begin", "end"]
        return pa.array([[dict(zip(names, m)) for m in found] for found in out], pa.list_(kind))

    return of(text)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, share: float, block_bytes: int = BLOCK_BYTES):
    """(ids, broadcast index) of the benchmark, block by block; the driver holds one block at a time.

    Items that are null or empty are left out.
    """
    small_batches(benchmark.sparkSession)
    context = benchmark.sparkSession.sparkContext
    ids, items, size = [], [], 0
    rows = benchmark.select(F.col(item_col), F.col(text_col)).orderBy(item_col, text_col)
    for item_id, text in rows.toLocalIterator():
        data = normalised(text)
        if not data:
            continue
        if items and size + len(data) > block_bytes:
            yield ids, context.broadcast(Index(items, share))
            ids, items, size = [], [], 0
        ids.append(item_id)
        items.append(data)
        size += len(data)
    if items:
        yield ids, context.broadcast(Index(items, share))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = MAX_EDITS,
) -> DataFrame:
    """One row for each row of `docs` and item found in it: id, item, edits, item_bytes, begin, end.

    Found is an item if some passage is at most `share` of the item's bytes in edits away, both
    lower-cased with one blank between words; `edits` is the fewest, `begin` and `end` are bytes of
    the normalised text. Null and empty texts hold nothing. Repeated rows of `docs` each give their
    rows, repeated items too. Other columns play no part.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for ids, index in blocks(benchmark, item_col, item_text_col, share):
        sizes = index.value.sizes.tolist()
        names = spark.createDataFrame(
            [(i, item, n) for i, (item, n) in enumerate(zip(ids, sizes))],
            f"_item int, _name {item_type.simpleString()}, _size long",
        )
        found = (
            given.select("_id", _searched(F.col("_text"), index).alias("_found"))
            .select("_id", F.explode("_found").alias("_match"))
            .join(F.broadcast(names), F.col("_match.item") == F.col("_item"))  # one block of items
            .select(
                F.col("_id").alias(id_col), F.col("_name").alias(item_col), "_match.edits",
                F.col("_size").alias("item_bytes"), "_match.begin", "_match.end",
            )
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        id_type = given.schema["_id"].dataType.simpleString()
        out = spark.createDataFrame(
            [],
            f"`{id_col}` {id_type}, `{item_col}` {item_type.simpleString()}, edits int, "
            "item_bytes long, begin long, `end` long",
        )
    return out


def without_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = MAX_EDITS,
) -> DataFrame:
    """The rows of `docs`, with their own columns, that hold no item of the benchmark."""
    for _, index in blocks(benchmark, item_col, item_text_col, share):
        docs = docs.filter(F.size(_searched(F.col(text_col), index)) == 0)
    return docs
