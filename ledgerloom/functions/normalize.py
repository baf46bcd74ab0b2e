"""Cleansing rules for text, dates, numbers and currency codes."""

from pyspark.sql import functions as F

# The currency codes accepted as they are.
CURRENCIES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY"]

# The characters that count as white space at the ends of a text.
_WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
# The number of a text between white space; a sign before `nan` is left out, as it has no meaning.
_FLOAT_TEXT = (
    rf"^[{_WHITE_SPACE}]*(?:[+-](?=(?i:nan)))?({_NUMBER}|[+-]?(?i:inf|infinity)|(?i:nan))[{_WHITE_SPACE}]*$"
)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c):
    """Remove white space of every kind at both ends (`trim` removes blanks only)."""
    return F.btrim(_col(c), F.lit(_WHITE_SPACE))


def has_text(c):
    """True when a text holds anything but white space; reads no further than the first such
    character, so it suits long texts."""
    return F.coalesce(_col(c).rlike(f"[^{_WHITE_SPACE}]"), F.lit(False))


def present(c):
    """True when a text value is neither null nor empty."""
    return F.coalesce(_col(c) != "", F.lit(False))


def text_or(c, default):
    """The text, or a default when it is null or empty."""
    return F.when(present(c), _col(c)).otherwise(F.lit(default))


def iso_date(c):
    """`yyyy-MM-dd` text to date; anything else gives null instead of an error."""
    return F.try_to_date(_col(c), "yyyy-MM-dd")


def iso_timestamp(c):
    return F.try_to_timestamp(_col(c))


def clean_vendor(c):
    return F.upper(F.trim(_col(c)))


def currency_or_usd(c):
    """Bronze rule: upper case, null becomes USD, no list of codes."""
    return F.upper(F.coalesce(_col(c), F.lit("USD")))


def normalize_currency(c):
    """Record rule: a known code after strip and upper case, else USD."""
    code = F.upper(strip(c))
    return F.when(code.isin(CURRENCIES), code).otherwise(F.lit("USD"))


def parse_float(c):
    """Text to double by the rules of a Python `float`; null when it is not a number."""
    number = F.regexp_extract(_col(c), _FLOAT_TEXT, 1)
    return F.replace(number, F.lit("_"), F.lit("")).try_cast("double")


def document_id(*parts):
    """Parts joined by `|`, every other special character replaced by `_`. Fixed value: the pattern."""
    joined = F.concat_ws("|", *[_col(p) for p in parts])
    return F.regexp_replace(joined, r"[^a-zA-Z0-9_\-|.]", "_")


def float_text(c):
    """A double as Python prints it: plain notation from 1e-4 up to 1e16, `None` for null."""
    value = _col(c)
    plain = F.regexp_replace(value.cast("string").try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.regexp_replace(plain, r"\.$", ".0")
    shown = value.cast("string")
    size = F.abs(value)
    scientific = F.regexp_replace(shown, r"\.0E", "E")
    scientific = F.regexp_replace(scientific, r"E(\d)", "e+$1")
    scientific = F.regexp_replace(scientific, r"E-", "e-")
    scientific = F.regexp_replace(scientific, r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(value.isNull(), F.lit("None"))
        .when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((value == 0) | ((size >= 1e-3) & (size < 1e7)), shown)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
