"""Values as the report pages show them."""

from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def money_text(c, missing="--"):
    """`$1,234.50`: two digits, a third one only where the value has it."""
    digits = F.format_number(F.round(_col(c), 3), 3)
    return F.coalesce(
        F.concat(F.lit("$"), F.regexp_replace(digits, r"(\.\d\d)0$", "$1")), F.lit(missing)
    )


def percent_text(c):
    """Share of one as a whole percent, null as 0%."""
    whole = F.round(F.coalesce(_col(c), F.lit(0.0)) * 100, 0).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("%"))


def flag_label(c):
    """`1 flag`, `2 flags`, nothing for none."""
    n = F.size(F.coalesce(_col(c), F.array().cast("array<string>")))
    return (
        F.when(n > 1, F.concat(n.cast("string"), F.lit(" flags")))
        .when(n == 1, F.lit("1 flag"))
        .otherwise(F.lit(""))
    )
