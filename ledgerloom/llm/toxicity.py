"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its terms: its lower-cased words and the beginnings of its longer words, hashed.
The score is the logistic function of

    bias + sum of w[i] + sum over pairs of <v[i], v[j]>

so a pair of terms can count for more than the sum of both, as an insult next to the mention of a
group does. All terms of the labelled sample that occur in a few texts take part in learning. A term gets
a weight and factors if it tells the classes apart by itself, or if it has a part in an interaction that
labels dealt out at random would not show, also where neither term of a pair tells anything alone; these
are trained with Adagrad, and all others are zero.
"""

import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch, release_unused, small_batches

MAX_LABELLED = 16_000  # labelled texts to train on; the first by the hash of their id
BUCKETS = 1 << 24
PREFIXES = (4, 5, 6)
MIN_TEXTS = 4  # that a term must occur in
MIN_SIGNIFICANCE = 15.0  # likelihood ratio of a term between the classes
ABOVE_CHANCE = 1.5  # of an interaction, over the strongest under shuffled labels
MIN_LOADING = 0.05  # of a term in an interaction, whose squares add up to 1
SHUFFLES = 3
POWER_STEPS = 12
PART_TERMS = 1 << 20  # of texts that are summed up at once
KNOWN_WORDS = 1 << 17  # whose terms a Python worker remembers
FACTORS = 8
EPOCHS = 30
BATCH = 256
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def _hashed(term):
    return crc32(term.encode("utf-8", "replace")) & (BUCKETS - 1)


@lru_cache(maxsize=1 << 16)
def _of_word(word):
    """The buckets of a word and of its beginnings; a beginning is marked as one."""
    return (_hashed(word), *[_hashed(f"{word[:n]}*") for n in PREFIXES if len(word) >= n])


def terms_of(text: str | None) -> set[int]:
    """The distinct hashed terms of a text; null and empty texts have none."""
    out = set()
    for word in set(_WORD.findall(text.lower())) if text else ():
        out.update(_of_word(word))
    return out


def terms(text: Column) -> Column:
    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        release_unused()
        return pa.array([sorted(terms_of(t.as_py())) for t in texts], pa.list_(pa.int32()))

    return of(text)


@dataclass
class Model:
    """A trained machine; `terms` are the sorted buckets that have a weight and factors."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.place = {int(t): i for i, t in enumerate(self.terms)}
        self.known = {}

    def _learn_word(self, word):
        """Places of the word's terms that have a weight; most words have none."""
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        found = tuple(self.place[t] for t in _of_word(word) if t in self.place)
        self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        found, words = set(), set(_WORD.findall(text.lower())) if text else ()
        for word, places in zip(words, [*map(self.known.get, words)]):
            if places is None:
                places = self._learn_word(word)
            if places:
                found.update(places)
        logit = self.bias
        if found:
            found = sorted(found)  # sums in one order, so that equal texts score equally
            v = self.factors[found]
            total = v.sum(axis=0)
            logit += self.weights[found].sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -30.0, 30.0))))


class _Sample:
    """Term sets of texts as a sparse matrix of zeros and ones, columns centred in products."""

    def __init__(self, lists, least=1):
        """`lists` holds the terms of each text; those that fewer than `least` texts have are left out."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([*(np.asarray(x, np.int32) for x in lists), np.empty(0, np.int32)])
        self._index(sizes, flat, least)

    @classmethod
    def joined(cls, sizes, flat, least=1):
        """The same from the terms of all texts in one int32 array, which is overwritten."""
        sample = cls.__new__(cls)
        sample._index(sizes, flat, least)
        return sample

    def _index(self, sizes, flat, least):
        """Besides `flat`, which ends up as the places, this holds one sorted copy of it and no table of
        all buckets."""
        self.n = len(sizes)
        ordered = np.sort(flat)
        first = np.ones(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(first)
        counts = np.diff(starts, append=len(ordered))
        often = counts >= max(least, 1)
        terms, self.counts = ordered[starts[often]], counts[often]
        del ordered, first, starts, counts, often
        self.terms = terms.astype(np.int64)
        known = np.append(terms, np.int32(-1))
        self.at, self.sizes, self.ends = flat, sizes, np.cumsum(sizes)
        left, kept = np.zeros(self.n, np.int64), 0
        for texts, found in self._parts():
            place = np.searchsorted(terms, found)
            here = known[place] == found
            own = sizes[texts]
            left[texts] = np.bincount(np.repeat(np.arange(len(own)), own)[here], minlength=len(own))
            place = place[here]
            flat[kept : kept + len(place)] = place
            kept += len(place)
        self.at, self.sizes, self.ends = flat[:kept], left, np.cumsum(left)
        self.mean = self.counts / max(self.n, 1)

    def _parts(self):
        """Stretches of texts of about `PART_TERMS` terms: sums go part by part, in little memory."""
        first = 0
        while first < self.n:
            begin = self.ends[first] - self.sizes[first]
            last = max(first + 1, int(np.searchsorted(self.ends, begin + PART_TERMS, "right")))
            yield slice(first, last), self.at[begin : self.ends[last - 1]]
            first = last

    def by_text(self, values):
        """Sums of the terms' values over the texts."""
        out = np.zeros(self.n)
        for texts, at in self._parts():
            own = self.sizes[texts]
            starts = (np.cumsum(own) - own)[own > 0]
            if len(starts):
                out[texts][own > 0] = np.add.reduceat(values[at], starts)
        return out

    def by_term(self, values):
        """Sums of the texts' values over the terms."""
        out = np.zeros(len(self.terms))
        for texts, at in self._parts():
            out += np.bincount(at, np.repeat(values[texts], self.sizes[texts]), len(self.terms))
        return out

    def having(self, chosen):
        """The lists, cut down to the chosen terms, a mask over `terms`."""
        left = chosen[self.at]
        cuts = np.cumsum(self.by_text(chosen.astype(np.float64)))[:-1].astype(np.int64)
        return np.split(self.terms[self.at[left]], cuts)


def _tells(sample, toxic):
    """Terms that tell the classes apart: by the likelihood ratio of a term's being in a texts of one
    class and b of the other against its being in both alike."""
    n, n_toxic = sample.n, toxic.sum()
    a = sample.by_term(toxic)
    b, share = sample.counts - a, sample.mean

    def part(observed, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(observed > 0, observed * np.log(observed / expected), 0.0)

    ratio = part(a, n_toxic * share) + part(b, (n - n_toxic) * share)
    ratio += part(n_toxic - a, n_toxic * (1 - share))
    ratio += part(n - n_toxic - b, (n - n_toxic) * (1 - share))
    return 2 * ratio >= MIN_SIGNIFICANCE


def _strongest(sample, residual, vectors, rng):
    """Largest eigenvalues and their vectors of the terms' products, weighed by the texts' residuals and
    without the diagonal: what factors would have to stand for. A text weighs the less, the more terms
    it has. By power iteration, without forming the matrix."""
    mean, n = sample.mean, len(sample.terms)
    length = sample.sizes - 2 * sample.by_text(mean) + (mean**2).sum()
    weight = residual / np.maximum(length, 1.0)
    diagonal = sample.by_term(weight) * (1 - 2 * mean) + mean**2 * weight.sum()

    def product(v):
        middle = weight * (sample.by_text(v) - mean @ v)
        return sample.by_term(middle) - mean * middle.sum() - diagonal * v

    found, _ = np.linalg.qr(rng.normal(size=(n, min(vectors, n))))
    for _ in range(POWER_STEPS):
        moved = np.stack([product(v) for v in found.T], axis=1)
        found, _ = np.linalg.qr(moved)
    vectors, strengths, _ = np.linalg.svd(moved, full_matrices=False)
    return strengths, vectors


def _interacts(sample, toxic, seed):
    """Terms of interactions that are stronger than the strongest one under shuffled labels."""
    if len(sample.terms) < 2 or not 0 < toxic.sum() < sample.n:
        return np.zeros(len(sample.terms), bool)
    rng = np.random.default_rng(seed)
    residual = toxic - toxic.mean()
    by_chance = max(_strongest(sample, rng.permutation(residual), 1, rng)[0][0] for _ in range(SHUFFLES))
    strength, vectors = _strongest(sample, residual, FACTORS // 2, rng)
    real = strength > ABOVE_CHANCE * by_chance
    return (np.abs(vectors[:, real]) >= MIN_LOADING).any(axis=1)


def fit(lists: list[np.ndarray], toxic: np.ndarray, seed: int = 11) -> Model:
    """Choose among all terms of the texts that `MIN_TEXTS` of them have, and train on the choice."""
    return _fit_sample(_Sample(lists, MIN_TEXTS), toxic, seed)


def _fit_sample(sample, toxic, seed=11):
    toxic = np.asarray(toxic, np.float64)
    chosen = _tells(sample, toxic) | _interacts(sample, toxic, seed)
    return train(sample.having(chosen) if sample.n else [], toxic, seed)


def _sums(groups, values, n):
    """Sums of the rows of `values` by group."""
    return np.stack([np.bincount(groups, weights=c, minlength=n) for c in values.T], axis=1)


def train(lists: list[np.ndarray], toxic: np.ndarray, seed: int = 11) -> Model:
    """Train on the terms of each text, as chosen, and its label."""
    toxic = np.asarray(toxic, np.float64)
    rate = (toxic.sum() + 1) / (len(toxic) + 2)
    bias = float(np.log(rate / (1 - rate)))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    indices = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    chosen = np.unique(indices)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS))
    if not len(chosen):
        return Model(bias, chosen, w, v)
    at = np.searchsorted(chosen, indices)
    starts = np.searchsorted(owner, np.arange(len(lists) + 1))
    sum_b, sum_w, sum_v = 1e-8, np.full(len(w), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(lists))
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            rows = rows.astype(np.int64)
            count = starts[batch + 1] - starts[batch]
            text = np.repeat(np.arange(len(batch)), count)
            f = at[rows]
            vf = v[f]
            total = _sums(text, vf, len(batch))
            square = np.bincount(text, weights=(vf**2).sum(axis=1), minlength=len(batch))
            logit = bias + np.bincount(text, weights=w[f], minlength=len(batch))
            logit += 0.5 * ((total**2).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[batch]) / len(batch)
            g = error.sum()
            sum_b += g * g
            bias -= 0.1 * g / np.sqrt(sum_b)
            g_w = np.bincount(f, weights=error[text], minlength=len(w))
            g_v = _sums(f, error[text][:, None] * (total[text] - vf), len(w))
            used = np.unique(f)
            g_w, g_v = g_w[used] + 1e-6 * w[used], g_v[used] + 1e-5 * v[used]
            sum_w[used] += g_w**2
            sum_v[used] += g_v**2
            w[used] -= 0.2 * g_w / np.sqrt(sum_w[used])
            v[used] -= 0.03 * g_v / np.sqrt(sum_v[used])
    return Model(bias, chosen, w, v)


def held_out(id_col: str) -> Column:
    """True for the third of the ids that no label is learned from."""
    digest = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(F.pmod(digest, F.lit(3)) == 1, F.lit(False))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Train on at most `max_labelled` labelled texts, none of them held out.

    Null labels and ids are left out, a repeated row counts once. Without labels the score is that of the
    bias, one half. The sample, whose rows are bounded, is learned from in one task; the model comes back.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .dropna()
        .filter(~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_labelled)
    )
    # The sample is bounded by `max_labelled` rows of two numbers.
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select(
            "doc_id",
            F.when(F.col("label") > 0, 1).otherwise(0).alias("label"),
            F.xxhash64("text").alias("hash"),
            terms(F.col("text")).alias("terms"),
        )
    )
    rows = scratch.store(texts, "texts")
    found = (
        rows.dropDuplicates(["doc_id", "hash", "label"])
        .orderBy(F.xxhash64("doc_id"), "doc_id", "hash", "label")
        .limit(max_labelled)
        .select("label", "terms")
        .coalesce(1)
        .mapInArrow(_fit, "bias double, terms array<int>, weights array<double>, factors array<double>")
        .collect()
    )
    scratch.drop(rows)
    if not found:
        return train([], np.array([]))
    model = found[0]
    factors = np.array(model["factors"], np.float64).reshape(-1, FACTORS)
    return Model(model["bias"], np.array(model["terms"], np.int64), np.array(model["weights"], np.float64), factors)


def _fit(batches):
    """The model of the whole sample, as one row. At the most, its terms are held twice."""
    sizes, parts, labels = [], [np.empty(0, np.int32)], []
    for batch in batches:
        # Copies, as a view of one column would hold the whole batch.
        labels.append(np.array(batch.column(0)))
        sizes.append(np.array(batch.column(1).value_lengths()))
        parts.append(np.array(batch.column(1).flatten()))
    flat = np.concatenate(parts)
    del parts
    release_unused()
    none = np.empty(0, np.int64)
    sample = _Sample.joined(np.concatenate([none, *sizes]), flat, MIN_TEXTS)
    del flat
    model = _fit_sample(sample, np.concatenate([none, *labels]))
    del sample
    columns = [
        pa.array([model.bias]),
        *[pa.array([x.ravel()], pa.list_(kind)) for x, kind in (
            (model.terms.astype(np.int32), pa.int32()), (model.weights, pa.float64()), (model.factors, pa.float64()))],
    ]
    yield pa.RecordBatch.from_arrays(columns, ["bias", "terms", "weights", "factors"])


def scores(text: Column, model: Model) -> Column:
    """The score of each text, from 0 to 1; null and empty texts have the score of the bias."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        release_unused()
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return of(text)


def score_documents(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row for each row of `docs`: id, held_out, score, predicted. Repeated rows stay, null ids
    are not held out, other columns play no part."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col), held_out(id_col).alias("held_out"), scores(F.col(text_col), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of `docs`, with their own columns, whose score is below the threshold."""
    small_batches(docs.sparkSession)
    return docs.filter(scores(F.col(text_col), model) < threshold)
