import re

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules as q
from ledgerloom.llm.queries import QUERIES
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(1 for i, x in enumerate(lines) if x in lines[:i]),
        len(repeated),
    )


def test_statistics_equal_the_plain_ones():
    texts = [
        None, "", " \n\t ", "a b c a b c", "a a a a", "x\x0by\x0cz\x1cq é 漢字", "one\none\n one\n\n",
        "# a | b\n# a | b", "a b c d b c d a b", "nbsp\xa0stays one",
    ]
    for text in texts:
        assert q.statistics_of(text)[:5] == plain_statistics(text)


def test_query_equals_the_plain_statistics(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op2_quality_rules"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if len(docs[r.doc_id]) > 8000:
            continue  # the plain count is quadratic
        expected = plain_statistics(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r.base_failed == failed and not (failed and r.kept)


def _table(n=600, seed=3):
    """Bad: (a >= 0.6 and b < 0.4) or c >= 0.9."""
    rng = np.random.default_rng(seed)
    table = {name: rng.random(n) for name in "abc"}
    bad = ((table["a"] >= 0.6) & (table["b"] < 0.4)) | (table["c"] >= 0.9)
    return table, ~bad


def test_rules_find_planted_conjunctions():
    table, good = _table()
    rules = q.learn_rules(table, good)
    held, truth = _table(seed=4)
    rejected = np.zeros(len(truth), bool)
    for rule in rules:
        rejected |= q._covered(rule, held, np.ones(len(truth), bool))
    assert (rejected == ~truth).mean() > 0.93
    assert len(rules) <= q.MAX_RULES and all(len(r) <= q.MAX_CONDITIONS for r in rules)
    assert all(str(c) for rule in rules for c in rule)


def test_no_rules_without_two_kinds_of_labels(spark, odd):
    table, good = _table()
    assert q.learn_rules(table, np.ones(len(good), bool)) == []
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert q.learn(odd, labels) == []


def test_pruning_drops_conditions_that_do_not_help():
    table, good = _table(900)
    noise = q.Condition("b", True, 0.01)
    rule = [q.Condition("c", True, 0.9), noise]
    every = np.ones(len(good), bool)
    assert q._prune(rule, table, ~good, every) == rule[:1]


def test_expression_equals_the_rules(spark):
    """The Spark expression decides as the rules do on the same numbers."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = q.learn(docs, labels)
    assert rules
    measured = q._with_statistics(docs, "text").select(
        *[c.alias(n) for n, c in q.features().items()], q.verdict(rules).alias("keep")
    )
    rows = measured.toPandas()
    table = {n: rows[n].to_numpy() for n in q.features()}
    rejected = np.zeros(len(rows), bool)
    for rule in rules:
        rejected |= q._covered(rule, table, np.ones(len(rows), bool))
    assert (rows["keep"].to_numpy() == ~rejected).all()


def test_verdicts_agree_with_held_out_labels(spark):
    """Learned on one half of the labels, right on the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rules = q.learn(docs, labels.filter(half))
    rows = q.apply_rules(docs, rules).join(labels.filter(~half), "doc_id").filter("NOT base_failed").toPandas()
    assert len(rows) > 1000
    assert (rows["kept"] == (rows["quality"] > 0)).mean() > 0.93


def test_odd_rows(odd, empty):
    rows = q.apply_rules(odd, []).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept for r in rows)
    assert q.apply_rules(empty, []).count() == 0
