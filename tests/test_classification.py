"""Categories learned from labelled invoices."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.operators.classification import (
    amount_sketches,
    anomaly_robust,
    classify_learned,
    classify_with_rules,
    learn_categories,
    merged_sketches,
)
from ledgerloom.plans import given
from ledgerloom.schemas import SPEND_CATEGORIES
from tests.conftest import DATA


def by_hand(labelled, texts):
    """Complement naive Bayes with smoothing 1, word by word."""
    counts, words_of = defaultdict(Counter), lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    for text, label in labelled:
        if label in SPEND_CATEGORIES:
            for word in words_of(text):
                counts[label][word] += 1
    vocabulary = {w for c in counts.values() for w in c}
    total = sum(sum(c.values()) for c in counts.values())
    out = []
    for text in texts:
        known, sums = words_of(text) & vocabulary, []
        for label in SPEND_CATEGORIES:
            rest = total - sum(counts[label].values()) + len(vocabulary)
            others = lambda w: sum(c[w] for name, c in counts.items() if name != label)  # noqa: B023, E731
            sums.append(-sum(math.log((others(w) + 1) / rest) for w in known))
        out.append((SPEND_CATEGORIES[sums.index(max(sums))], len(known)) if known else (None, 0))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "i int, t string, spend_category string")


def test_scores_equal_the_formula(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(200):
        n = rng.randrange(10)
        words = rng.choices(vocabulary[n * 4 : n * 4 + 6] + vocabulary[:3], k=rng.randint(1, 6))
        rows.append((" ".join(words).upper(), rng.choice([SPEND_CATEGORIES[n]] * 8 + [None, "Gardening"])))
    texts = [t for t, _ in rows] + ["unknown words", "", "w1 w39 w39"]
    model = learn_categories(frame(spark, rows), text=F.col("t"))
    asked = frame(spark, [(t, None) for t in texts])
    for settle in (False, True):
        got = {r.i: r for r in classify_learned(asked, model, F.col("t"), settle).collect()}
        assert len(got) == len(texts)
        for i, (category, known) in enumerate(by_hand(rows, texts)):
            assert got[i].known_words == known
            assert got[i].learned_category == (category or "Other")
            assert (got[i].learned_confidence == 0) == (known == 0)


def test_held_out_accuracy(spark):
    """Invoices that the model has not seen, by the words of their items."""
    rows = given.invoices(spark, DATA, "id", "vendor_name", "line_items", "spend_category")
    rows = rows.withColumn("k", F.substring_index("id", "-", 1).cast("bigint")).filter("spend_category is not null")
    model = learn_categories(rows.filter("floor(k / 7) % 3 != 0"))
    held = classify_learned(rows.filter("floor(k / 7) % 3 = 0 and k % 6 > 0"), model)
    right = F.avg((F.col("learned_category") == F.col("spend_category")).cast("int"))
    ruled = F.avg((F.col("rule") == F.col("spend_category")).cast("int"))
    by_rules = classify_with_rules(rows.filter("floor(k / 7) % 3 = 0 and k % 6 > 0"))
    by_rules = by_rules.withColumn("rule", F.col("rule_category")).agg(ruled).first()[0]
    learned, sure = held.agg(right).first()[0], held.filter("learned_confidence >= 0.8").agg(right).first()[0]
    assert learned > by_rules + 0.2 and (sure is None or sure >= learned)


def test_nothing_to_learn_from(spark):
    rows = frame(spark, [("paper", None), ("flight", "Gardening")])
    model = learn_categories(rows, text=F.col("t"))
    assert model.count() == 0
    got = {r.t: r.learned_category for r in classify_learned(rows, model, F.col("t")).collect()}
    assert got == {"paper": "Supplies", "flight": "Travel"}
    assert classify_learned(rows.limit(0), model, F.col("t")).count() == 0


def quartile(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def test_quartiles_of_small_vendors_are_exact_and_one_outlier_moves_nothing(spark):
    rng = random.Random(4)
    amounts = {f"v{v}": [round(rng.uniform(10, 20), 2) for _ in range(rng.randint(1, 300))] for v in range(6)}
    amounts["v0"][0] = 1e9
    amounts[None] = [1.0, 2.0, 100.0]
    rows = [(v, a) for v, x in amounts.items() for a in x] + [("v1", None), ("v1", float("nan")), ("new", None)]
    df = spark.createDataFrame(rows, "vendor_name string, total_amount double")
    parts = amount_sketches(df.filter("total_amount > 15")).unionByName(amount_sketches(df.filter("total_amount <= 15")))
    for sketches in (None, merged_sketches(parts)):
        got = anomaly_robust(df, sketches).collect()
        assert len(got) == len(rows)
        for r in got:
            known = amounts.get(r.vendor_name)
            if known is None or r.total_amount is None or math.isnan(r.total_amount):
                assert r.is_far_out == (r.total_amount is not None and r.high_limit is not None and math.isnan(r.total_amount))
                continue
            low, high = quartile(known, 0.25), quartile(known, 0.75)
            assert r.median_amount == quartile(known, 0.5)
            assert math.isclose(r.high_limit, high + 3 * (high - low))
            assert r.is_far_out == (r.total_amount > high + 3 * (high - low))
    assert [r.total_amount for r in got if r.is_far_out and r.vendor_name == "v0"] == [1e9]


def test_ranks_of_a_large_vendor_are_near(spark):
    df = spark.range(200_000).selectExpr("'big' as vendor_name", "cast(id as double) as total_amount")
    (row,) = anomaly_robust(df).select("median_amount", "high_limit").distinct().collect()
    assert abs(row.median_amount / 200_000 - 0.5) < 0.01
    assert abs(row.high_limit / 200_000 - (0.75 + 3 * 0.5)) < 0.05


def test_settled_counts_give_the_same_model(spark):
    """With `settle` the words are split once, for all four aggregates of the counts."""
    from ledgerloom.operators.classification import learn_categories

    labelled = spark.createDataFrame(
        [("red pen", "Supplies"), ("red car", "Travel"), ("blue car car", "Travel"), ("x", None), (None, "HR")],
        "text string, spend_category string",
    )
    lazy = learn_categories(labelled, text="text")
    model = learn_categories(labelled, text="text", settle=True)
    assert "regexp_extract_all" not in model._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, model.collect())) == sorted(map(str, lazy.collect())) and model.count() == 4
