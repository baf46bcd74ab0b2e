"""Format-preserving pseudonyms for personal numbers, dates and addresses in texts.

A value is found by its pattern, validated (check digits, calendar, number plan), turned into an
integer, moved by a keyed Feistel permutation of all valid values of its format, and written back in
the layout it was found in. Equal values get equal pseudonyms in all documents and in every layout,
different values get different ones, every pseudonym is valid again, and no value stays as it was.
Whoever has the key can turn a pseudonym back.

Phone numbers with +1 or an area in parentheses that miss the North American plan move among the numbers
that miss it. Dates move within the years 1900 to 2099: those whose day is above 12 among themselves, and
the others among themselves. So a date that can be read in one order only gets a pseudonym that can be
read in that order only, and one permutation serves all layouts. Not moved are earlier and later dates,
and months written as words.
"""

import re
from bisect import bisect_left
from collections import Counter
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.feistel import Permutation
from ledgerloom.llm.scratch import small_batches

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
CARD_PREFIX = 6  # digits of a card's issuer, which stay
# Fixed values of the numbering plans: the first digits of cards, areas a social security number has
# not, lengths of bank account numbers by country are not checked beyond the check digits.
CARD_STARTS = "23456"
SSN_AREAS = [a for a in range(1, 900) if a != 666]

_PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@"
    r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<![\w-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<iso>(?<![\w/.-])[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}(?:(?=[Tt][0-9])|(?![\w/-]|\.[0-9])))"
    r"|(?P<day>(?<![\w/.-])[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4}(?:(?=[Tt][0-9])|(?![\w/-]|\.[0-9])))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?(?:[0-9]{1,4}[ .-]?){1,4}[0-9]{2,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<s3>[ .-])[0-9]{3}(?P=s3)[0-9]{4})(?![\w]|-[0-9]))"
    r"|(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))"
)
_HINT = re.compile(r"[0-9]+|@")
_BEFORE, _AFTER = 66, 260  # characters of a value before its first and after its last digit or @
KINDS = ["email", "iban", "ip", "date", "ssn", "phone", "card"]


@lru_cache(maxsize=4096)
def _permutation(n, key, kind):
    return Permutation(n, key + b"/" + kind.encode())


def _luhn(digits):
    """The check digit that belongs behind the digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return str(-total % 10)


def _mixed(value, alphabets, key, kind, back):
    """Move a text whose i-th character is of the i-th alphabet."""
    number, total = 0, 1
    for c, alphabet in zip(value, alphabets):
        number = number * len(alphabet) + alphabet.index(c)
        total *= len(alphabet)
    moved = _permutation(total, key, kind + ":" + "".join(a[0] + str(len(a)) for a in alphabets))
    number = moved.original(number) if back else moved.pseudonym(number)
    out = []
    for alphabet in reversed(alphabets):
        number, at = divmod(number, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


def _of_classes(value, key, kind, back):
    """Move letters to letters and digits to digits; case and other characters stay in place."""
    lower = value.lower()
    kept = [i for i, c in enumerate(lower) if c in DIGITS or c in LETTERS]
    if not kept:
        return value
    alphabets = [DIGITS if lower[i] in DIGITS else LETTERS for i in kept]
    moved = _mixed("".join(lower[i] for i in kept), alphabets, key, kind, back)
    out = list(value)
    for i, c in zip(kept, moved):
        out[i] = c.upper() if value[i].isupper() else c
    return "".join(out)


def _lay_out(found, digits):
    """Write digits over those of the text found."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in found)


def _email(found, key, back):
    local, _, domain = found.rpartition("@")
    return f"{_of_classes(local, key, 'email@' + domain.lower(), back)}@{domain}"


def _iban(found, key, back):
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return None
    number = lambda text: int("".join(str(int(c, 36)) for c in text))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    rest = _of_classes(plain[4:], key, "iban" + plain[:2], back)
    check = 98 - number(rest + plain[:2] + "00") % 97
    new = iter(f"{plain[:2]}{check:02d}{rest}")
    return "".join(" " if c == " " else next(new) for c in found)


def _ip(found, key, back):
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = int.from_bytes(bytes(map(int, parts)), "big")
    moved = _permutation(1 << 32, key, "ip")
    number = moved.original(number) if back else moved.pseudonym(number)
    return ".".join(map(str, number.to_bytes(4, "big")))


@lru_cache(maxsize=2)
def _days(late):
    """Ordinals of the days above 12 of all months, or of the others."""
    every = range(FIRST_DAY, LAST_DAY + 1)
    return [n for n in every if (date.fromordinal(n).day > 12) == late]


def _moved_day(year, month, day, key, back):
    try:
        number = date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= number <= LAST_DAY:
        return None
    late = day > 12
    days = _days(late)
    moved = _permutation(len(days), key, "date-late" if late else "date-early")
    at = bisect_left(days, number)
    return date.fromordinal(days[moved.original(at) if back else moved.pseudonym(at)])


def _iso(found, key, back):
    new = _moved_day(int(found[:4]), int(found[5:7]), int(found[8:]), key, back)
    return new and new.strftime(f"%Y{found[4]}%m{found[4]}%d")


def _day(found, key, back):
    """Month first with slashes, day first otherwise, and the other way round where only that is a date;
    both parts are written with two digits."""
    sign = next(c for c in found if c not in DIGITS)
    first, second, year = map(int, found.split(sign))
    layouts = [f"%m{sign}%d{sign}%Y", f"%d{sign}%m{sign}%Y"]
    month, day = (first, second) if sign == "/" else (second, first)
    new = _moved_day(year, month, day, key, back)
    if new is not None:
        return new.strftime(layouts[sign != "/"])
    new = _moved_day(year, day, month, key, back)
    return new and new.strftime(layouts[sign == "/"])


def _ssn(found, key, back):
    area, group, serial = map(int, found.split("-"))
    if area not in SSN_AREAS or not group or not serial:
        return None
    number = (SSN_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1
    moved = _permutation(len(SSN_AREAS) * 99 * 9999, key, "ssn")
    number = moved.original(number) if back else moved.pseudonym(number)
    number, serial = divmod(number, 9999)
    area, group = divmod(number, 99)
    return f"{SSN_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


# First digits of area and exchange that the North American plan does not have together.
_OFF_PLAN = [a + b for a in DIGITS for b in DIGITS if a in "01" or b in "01"]


def _off_plan(local, key, back):
    """Move ten digits that miss the plan among those that do."""
    rest = local[1:3] + local[4:]
    moved = _mixed([local[0] + local[3], *rest], [_OFF_PLAN, *[DIGITS] * 8], key, "phone1-off-plan", back)
    return moved[0] + moved[2:4] + moved[1] + moved[4:]


def _phone(found, key, back):
    digits = "".join(c for c in found if c in DIGITS)
    if not found.startswith("+") or (digits.startswith("1") and len(digits) == 11):
        country, local = digits[:-10], digits[-10:]
        first = DIGITS[2:]
        if len(local) < 10:
            return None
        if local[0] not in first or local[3] not in first:
            if found[0] in DIGITS:  # without + or parentheses these may be other numbers
                return None
            return _lay_out(found, country + _off_plan(local, key, back))
        alphabets = [first, DIGITS, DIGITS, first, *[DIGITS] * 6]
        return _lay_out(found, country + _mixed(local, alphabets, key, "phone1", back))
    if not 8 <= len(digits) <= 15:
        return None
    kept = digits[:3]
    alphabets = [DIGITS] * (len(digits) - 3)
    return _lay_out(found, kept + _mixed(digits[3:], alphabets, key, "phone" + kept, back))


def _card(found, key, back):
    digits = "".join(c for c in found if c in DIGITS)
    if digits[0] not in CARD_STARTS or _luhn(digits[:-1]) != digits[-1]:
        return None
    kept, middle = digits[:CARD_PREFIX], digits[CARD_PREFIX:-1]
    new = kept + _mixed(middle, [DIGITS] * len(middle), key, "card" + kept, back)
    return _lay_out(found, new + _luhn(new))


_MOVE = {
    "email": _email, "iban": _iban, "ip": _ip, "iso": _iso, "day": _day, "ssn": _ssn,
    "phone": _phone, "card": _card,
}


def _regions(text):
    """Stretches of the text around digits and @ signs, beyond which no value can reach."""
    begin = end = None
    for hint in _HINT.finditer(text):
        first = max(0, hint.start() - _BEFORE)
        if begin is not None and first <= end:
            end = max(end, hint.end() + _AFTER)
            continue
        if begin is not None:
            yield begin, end
        begin, end = first, hint.end() + _AFTER
    if begin is not None:
        yield begin, min(end, len(text))


def replace_values(text: str, key: bytes, back: bool = False):
    """The text with its values moved, and how many of each kind. `back` undoes it."""
    found, out, at = Counter(), [], 0
    for search, end in _regions(text):
        while match := _PATTERN.search(text, search, end):
            kind = _kind(match)
            new = _MOVE[kind](match[0], key, back)
            if new is None:  # not valid: look for another value from its second character on
                search = match.start() + 1
                continue
            found["date" if kind in ("iso", "day") else kind] += 1
            out += [text[at : match.start()], new]
            at = search = match.end()
    return "".join([*out, text[at:]]), found


def _kind(match):
    return next(kind for kind in _MOVE if match[kind] is not None)


def _key_bytes(key):
    key = key.encode() if isinstance(key, str) else key
    if not key:
        raise ValueError("a key is needed")
    return key


def pseudonymise(
    docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = None, back: bool = False
) -> DataFrame:
    """The rows of `docs` with the personal values in their texts replaced.

    All other columns stay, whatever their names; `counts_col` adds a map from kind (`KINDS`) to the
    number of values replaced. Texts without values, null and empty texts stay as they are (the map is
    then empty). Rows are handled one by one: repeated rows stay repeated, an empty table stays empty.
    `back` restores the values of texts that were written with the same key, but for the case of
    one-digit days and months, which are written with two digits.
    """
    key = _key_bytes(key)
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<text string, counts map<string,int>>")
    def replaced(texts: pa.Array) -> pa.Array:
        new, counts = [], []
        for value in texts:
            text = value.as_py()
            moved, found = replace_values(text, key, back) if text else (None, {})
            new.append(moved if found else None)  # unchanged texts are not sent back
            counts.append(sorted(found.items()))
        fields = [pa.array(new, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int32()))]
        return pa.StructArray.from_arrays(fields, names=["text", "counts"])

    order = docs.columns
    given = F.col(f"`{text_col}`")
    new = "_replaced"
    while new.lower() in {c.lower() for c in order}:
        new += "_"
    made = docs.select(*[F.col(f"`{c}`") for c in order], replaced(given).alias(new))
    columns = [
        F.coalesce(f"{new}.text", given).alias(c) if c == text_col else F.col(f"`{c}`") for c in order
    ]
    if counts_col:
        columns.append(F.col(f"{new}.counts").alias(counts_col))
    return made.select(*columns)
