"""Scoring stages for spend categories, by rules and learned, and rule-based anomaly flags."""

from pyspark.sql import functions as F

from ledgerloom.functions.money import money_avg
from ledgerloom.functions.normalize import iso_date, present
from ledgerloom.operators.lookup import group_values, join_values, with_group_values
from ledgerloom.schemas import SPEND_CATEGORIES
from ledgerloom.sources.tables import settled

# Our own keyword rules: term, category, weight.
KEYWORD_RULES = [
    ("software", "IT", 3),
    ("laptop", "IT", 2),
    ("advertising", "Marketing", 3),
    ("campaign", "Marketing", 2),
    ("cleaning", "Facilities", 3),
    ("rent", "Facilities", 1),
    ("flight", "Travel", 3),
    ("hotel", "Travel", 2),
    ("recruiting", "HR", 3),
    ("training", "HR", 1),
    ("contract review", "Legal", 3),
    ("attorney", "Legal", 3),
    ("advisory", "Consulting", 3),
    ("consulting", "Consulting", 2),
    ("paper", "Supplies", 2),
    ("toner", "Supplies", 3),
    ("electricity", "Utilities", 3),
    ("water", "Utilities", 1),
]

# The amount that counts as round, and the multiple of the vendor's average that counts as high.
ROUND_AMOUNT = 100
HIGH_MULTIPLE = 3


def classify_with_rules(df, rules=None, text=None):
    """Add the category with the highest weight of terms found, `Other` when none is.

    Looks at the vendor and the line item descriptions unless another text column is given. Ties
    go to the category named first. The rules are few and become one expression, without a join.
    """
    rules = KEYWORD_RULES if rules is None else rules
    if text is None:
        text = F.concat_ws(" ", "vendor_name", F.col("line_items.description"))
    scored = df.withColumn("_text", F.lower(text))
    weights = []
    for rank, category in enumerate(SPEND_CATEGORIES):
        terms = [(t, w) for t, c, w in rules if c == category]
        if terms:
            weight = sum(
                (F.when(F.contains("_text", F.lit(t)), w).otherwise(0) for t, w in terms), F.lit(0)
            )
            weights.append(
                F.struct(weight.alias("weight"), F.lit(-rank).alias("rank"), F.lit(category).alias("category"))
            )
    best = F.array_max(F.array(*weights))
    return (
        scored.withColumn("_best", best)
        .withColumn("rule_weight", F.col("_best.weight"))
        .withColumn(
            "rule_category",
            F.when(F.col("_best.weight") > 0, F.col("_best.category")).otherwise("Other"),
        )
        .drop("_text", "_best")
    )


SMOOTHING = 1.0
WEIGHT = "decimal(18,9)"  # exact, so that sums do not depend on the order of words


def _words(df, text):
    if text is None:
        text = F.concat_ws(" ", "vendor_name", F.col("line_items.description"))
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def learn_categories(labelled, label="spend_category", text=None, settle=False):
    """A model of the words of labelled invoices: `word` and `weights`, one for each category.

    Complement naive Bayes: a word weighs for a category by how rare it is in all others, so a category
    with many invoices is not favoured. A word counts once for an invoice. Rows whose label is none of
    the categories are left out. The counts are partially aggregated, and one row a word is left. Four
    aggregates read them: with `settle` they are written first, and the invoices are read once.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in SPEND_CATEGORIES]), F.col(label))
    words = labelled.filter(rank > 0).select(rank.alias("rank"), F.explode(_words(labelled, text)).alias("word"))
    counts = words.groupBy("word", "rank").agg(F.count(F.lit(1)).alias("n"))
    counts = settled(counts, settle, "category-counts")
    places = range(1, len(SPEND_CATEGORIES) + 1)
    by_word = counts.groupBy("word").agg(
        F.sum("n").alias("all"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("rank") == i, F.col("n"))), F.lit(0)) for i in places]).alias("own"),
    )
    totals = counts.groupBy().agg(
        F.sum("n").alias("sum"),
        F.count_distinct("word").alias("words"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("rank") == i, F.col("n"))), F.lit(0)) for i in places]).alias("sums"),
    )

    def weight(own, i):
        elsewhere = (F.col("all") - own + SMOOTHING) / (F.col("sum") - F.col("sums")[i] + SMOOTHING * F.col("words"))
        return (-F.log(elsewhere)).cast(WEIGHT)

    known = {c: totals.select(c).scalar() for c in ("sum", "words", "sums")}
    return by_word.withColumns(known).select("word", F.transform("own", weight).alias("weights"))


def classify_learned(df, model, text=None, settle=False):
    """Add `learned_category`, the category whose words' weights add up to most (the one named first on a
    tie), its `learned_confidence` among all by these sums, and `known_words`. Invoices without a known
    word get the category of the rules and confidence 0.

    Words are joined to the model, which is one row a word; a word that a third of all invoices have is
    split over tasks. With `settle` the model is written first and its real size decides the join.
    """
    model = group_values(model, ["word"], weights=F.first("weights"))
    model = settled(model, settle, "category-model")
    rows = settled(df.withColumn("_row", F.monotonically_increasing_id()), settle, "to-classify")
    words = rows.select("_row", F.explode(_words(df, text)).alias("word"))
    found = join_values(words, F.struct("word"), model, "inner")
    places = range(len(SPEND_CATEGORIES))
    sums = found.groupBy("_row").agg(
        F.array(*[F.sum(F.col("weights")[i]) for i in places]).alias("_sums"), F.count(F.lit(1)).alias("_known")
    )
    best = F.array_max("_sums")
    apart = F.aggregate(
        "_sums", F.lit(0.0), lambda total, s: total + F.exp((s - best).cast("double"))
    )
    named = F.array(*[F.lit(c) for c in SPEND_CATEGORIES])
    ruled = classify_with_rules(rows, text=text)
    return (
        ruled.join(sums, "_row", "left")
        .withColumns(
            {
                "learned_category": F.coalesce(
                    F.get(named, (F.array_position("_sums", best) - 1).cast("int")), "rule_category"
                ),
                "learned_confidence": F.coalesce(F.round(1 / apart, 6), F.lit(0.0)),
                "known_words": F.coalesce("_known", F.lit(0)),
            }
        )
        .drop("_row", "_sums", "_known", "rule_category", "rule_weight")
    )


def classify_with(df, scorer, schema):
    """Run a scorer over batches of rows: a function from an iterator of pandas frames to one."""
    return df.mapInPandas(scorer, schema)


def anomaly_flags(amount, purchase_order, date, vendor_average):
    """The flags an invoice earns by rule, as an array column."""
    day = F.dayofweek(date)
    return F.array_compact(
        F.array(
            F.when(amount > vendor_average * HIGH_MULTIPLE, F.lit("unusually_high_amount")),
            F.when((amount != 0) & (amount % ROUND_AMOUNT == 0), F.lit("round_number")),
            F.when(day.isin(1, 7), F.lit("weekend_date")),
            F.when(~present(purchase_order), F.lit("missing_po")),
        )
    )


def anomaly_rules(df, settle=False):
    """Add `rule_flags`; the vendor's average is over all invoices given (`settle` as in
    `with_group_values`)."""
    return (
        with_group_values(df, ["vendor_name"], settle, _average=money_avg("total_amount"))
        .withColumn(
            "rule_flags",
            anomaly_flags(
                F.col("total_amount"),
                F.col("purchase_order"),
                iso_date("invoice_date"),
                F.col("_average"),
            ),
        )
        .drop("_average")
    )


SKETCH_SIZE = 1024  # of a vendor's sketch; up to about as many amounts it is exact
FAR_OUT = 3.0  # spreads between the quartiles beyond the upper one


def amount_sketches(df, size=SKETCH_SIZE):
    """A quantile sketch (KLL) of the amounts of each vendor: `vendor_name`, `sketch`, `n`.

    Sketches are aggregated partially, so a large vendor is no large group, and those of several batches
    or tables merge (`merged_sketches`). Amounts that are null or not finite play no part.
    """
    amount = F.col("total_amount")
    usable = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    return df.filter(usable).groupBy("vendor_name").agg(
        F.kll_sketch_agg_double(amount, F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def merged_sketches(sketches):
    """One sketch for each vendor, of several tables of sketches put together."""
    return sketches.groupBy("vendor_name").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n")
    )


def anomaly_robust(df, sketches=None, far_out=FAR_OUT, settle=False):
    """Add `median_amount`, `high_limit` and `is_far_out`: whether the amount lies more than `far_out`
    times the spread between the quartiles above the upper quartile of its vendor's amounts.

    One very large amount moves an average, and with it a limit of three times the average; it does not
    move quartiles. `sketches` are those of the invoices to compare with, by default those given. A
    vendor's quartiles are exact for up to about `SKETCH_SIZE` amounts, and within about 1 % of the ranks
    beyond. Invoices without an amount, or whose vendor has no sketch, are not far out.
    """
    sketches = amount_sketches(df) if sketches is None else sketches

    def quantile(q):
        return F.kll_sketch_get_quantile_double("sketch", F.lit(q))

    values = group_values(
        sketches, ["vendor_name"],
        low=F.first(quantile(0.25)), middle=F.first(quantile(0.5)), high=F.first(quantile(0.75)),
    )
    values = settled(values, settle, "vendor-quartiles")
    limit = F.col("high") + far_out * (F.col("high") - F.col("low"))
    return (
        join_values(df, F.struct("vendor_name"), values)
        .withColumns(
            {
                "median_amount": F.col("middle"),
                "high_limit": limit,
                "is_far_out": F.coalesce(F.col("total_amount") > limit, F.lit(False)),
            }
        )
        .drop("low", "middle", "high")
    )
