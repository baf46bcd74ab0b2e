"""Quality filter: base rules and a learned decision list over statistics of the text.

The list is learned by sequential covering. Labelled texts are split in a part to grow on and a part
to prune on. A rule is a conjunction of thresholds for "bad"; it grows by the condition with the
largest information gain, then loses conditions from its end as long as that does not hurt it on the
other part. Texts it covers are taken out, and the next rule is learned, until no rule is worth
adding. The result is an ordered conditional expression in Spark that anybody can read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import small_batches

MAX_LABELLED = 20_000  # labelled texts that the list is learned from; taken by the hash of the id
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLDS = 64  # tried for each statistic
MIN_COVERED = 8
MAX_RULES = 24
MAX_CONDITIONS = 4
MIN_PRECISION = 0.8
# Fixed values of the statistics' definition.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

STATISTICS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_lines", pa.int64()),
    ("n_distinct_words", pa.int64()),
    ("n_upper", pa.int64()),
    ("n_digits", pa.int64()),
    ("n_marks", pa.int64()),
    ("longest_word", pa.int64()),
]
_UPPER = bytes(range(65, 91))
_OTHERS = bytes(set(range(256)) - set(range(65, 91)))
_NO_DIGITS = bytes(set(range(256)) - set(range(48, 58)))


def _repeated_words(words):
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first, marked = {}, bytearray(len(words))
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            marked[i : i + 3] = marked[j : j + 3] = b"\1\1\1"
    return sum(marked)


def statistics_of(text: str | None):
    """The statistics of one text, in the order of `STATISTICS`; null counts as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()  # at ASCII white space
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        len(set(words)),
        len(data.translate(None, _OTHERS)),
        len(data.translate(None, _NO_DIGITS)),
        text.count("!") + text.count("?"),
        max(map(len, words), default=0),
    )


def statistics(text: Column) -> Column:
    """The statistics of a text column as one struct."""
    names = [name for name, _ in STATISTICS]

    @F.arrow_udf("struct<" + ",".join(f"{name}: bigint" for name in names) + ">")
    def of(texts: pa.Array) -> pa.Array:
        rows = [statistics_of(t.as_py()) for t in texts]
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return of(text)


def _share(part, whole):
    return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """The numbers that conditions compare, by name, from the columns of the statistics."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
        "distinct_share": _share("n_distinct_words", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
        "longest_word": F.col("longest_word").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, table):
        values = table[self.feature]
        return values >= self.threshold if self.at_least else values < self.threshold

    def column(self):
        value = features()[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self):
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def _covered(rule, table, rows):
    for condition in rule:
        rows = rows & condition.holds(table)
    return rows


def _gain(bad, good, bad_before, good_before):
    with np.errstate(divide="ignore", invalid="ignore"):
        after = np.log2(bad / (bad + good))
        before = np.log2(bad_before / (bad_before + good_before))
        return np.where(bad > 0, bad * (after - before), -np.inf)


def _grow(table, bad, rows, names):
    """Conditions added by the best gain until no good text is covered."""
    rule = []
    while len(rule) < MAX_CONDITIONS:
        here, y = np.flatnonzero(rows), bad[rows]
        n_bad, n_good = y.sum(), len(y) - y.sum()
        if not n_bad or not n_good:
            break
        best = (1e-9, None)
        for name in names:
            values = table[name][here]
            # Bad texts may be rare, so their own quantiles are tried too.
            steps = np.linspace(0, 1, THRESHOLDS + 2)[1:-1]
            cuts = np.unique(np.quantile(values, steps).tolist() + np.quantile(values[y], steps).tolist())
            order = np.argsort(values, kind="stable")
            ranked = np.concatenate([[0], np.cumsum(y[order])])
            at = np.searchsorted(values[order], cuts)
            below_bad, below = ranked[at], at
            for at_least in (False, True):
                b = n_bad - below_bad if at_least else below_bad
                g = (len(y) - below if at_least else below) - b
                gain = np.where(b + g >= MIN_COVERED, _gain(b, g, n_bad, n_good), -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, at_least, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = rows & best[1].holds(table)
    return rule


def _prune(rule, table, bad, rows):
    """The shortest start of the rule with the best precision on the texts kept for pruning."""

    def worth(part):
        covered = _covered(part, table, rows)
        p = (covered & bad).sum()
        return (p + 1) / (covered.sum() + 2)

    starts = [rule[:i] for i in range(1, len(rule) + 1)]
    return max(starts, key=lambda part: (worth(part), -len(part)))


def learn_rules(table: dict[str, np.ndarray], good: np.ndarray, seed: int = 7):
    """An ordered list of rules for bad texts; a text is good if none covers it."""
    names = sorted(table)
    bad = ~np.asarray(good, bool)
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES:
        rule = _grow(table, bad, left & grow, names)
        if not rule:
            break
        rule = _prune(rule, table, bad, left & ~grow)
        covered = _covered(rule, table, left)
        if covered.sum() < MIN_COVERED or (covered & bad).sum() < MIN_PRECISION * covered.sum():
            break
        rules.append(tuple(rule))
        left &= ~covered
    return rules


def verdict(rules) -> Column:
    """The list as a Spark expression over the statistics: true to keep."""
    if not rules:
        return F.lit(True)
    out = F
    for rule in rules:
        condition = rule[0].column()
        for other in rule[1:]:
            condition = condition & other.column()
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def _with_statistics(docs, text_col):
    names = [name for name, _ in STATISTICS]
    return docs.withColumn("_s", statistics(F.col(text_col))).select(
        "doc_id", *[F.col(f"_s.{name}") for name in names]
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
):
    """Learn rules from at most `max_labelled` labelled texts, the first by the hash of their ids.

    Labels that are null are left out. Without labels, or with labels of one kind, there are no rules.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .dropna()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_labelled)
    )
    # The sample is bounded by `max_labelled` rows of two numbers.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    names = [name for name, _ in STATISTICS]
    measured = texts.withColumn("_s", statistics(F.col("text"))).select(
        "doc_id", "label", *[F.col(f"_s.{name}") for name in names]
    )
    rows = (
        measured.select("doc_id", "label", *[c.alias(n) for n, c in features().items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id", *features(), "label")
        .limit(max_labelled)
        .toPandas()
    )
    if rows.empty:
        return []
    table = {name: rows[name].to_numpy(np.float64) for name in features()}
    return learn_rules(table, rows["label"].to_numpy() > 0)


def apply_rules(
    docs: DataFrame, rules, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: the id, the statistics, base_failed and kept.

    `base_failed` marks texts below `MIN_WORDS` words or with more than `MAX_REPEAT_PERCENT` percent
    of their words in repeated windows; null and empty texts have no words and fail. `kept` is false
    for them, else the verdict of the list. Repeated rows stay; other columns play no part.
    """
    small_batches(docs.sparkSession)
    rows = _with_statistics(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        rows.withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
        .withColumnRenamed("doc_id", id_col)
    )
