"""Money aggregates that do not depend on the order in which rows arrive."""

from pyspark.sql import functions as F

SCALE = 6  # decimals that sums are exact to
DIGITS = 18  # before the point


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def exact_money(c, scale=SCALE):
    """An amount as decimal, rounded to `scale` decimals (10 at most); null if it does not fit."""
    return _col(c).try_cast(f"decimal({DIGITS + scale},{scale})")


def money_sum(c, scale=SCALE):
    """Sum of a double column, added up exactly in decimal and returned as double.

    Sums of doubles change in the last bits with the order of addition, so a retried task could
    give another total. Each amount is rounded to `scale` decimals before it is added. Amounts that
    do not fit the decimal (beyond 1e18, NaN, infinite) are added as doubles, not dropped. Null when
    there is no amount at all.
    """
    amount = _col(c)
    exact = exact_money(c, scale)
    total = F.sum(exact).cast("double")
    outside = F.sum(F.when(exact.isNull(), amount))
    return F.when(outside.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + outside)


def money_avg(c, scale=SCALE):
    """Average over the non-null amounts, from the exact sum."""
    return F.try_divide(money_sum(c, scale), F.count(_col(c)))
