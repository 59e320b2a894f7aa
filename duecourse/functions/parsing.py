"""Strict text parsing as column expressions: a value that cannot be read becomes NULL.

Nothing here raises. ``operators.clean.unparsed`` counts what was text but did not parse, and
``operators.clean.clean_strict`` turns a non-empty count into an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# What an employment length may look like, and the years it stands for.
EMPLOYMENT_YEARS = {
    "< 1 year": 0.0,
    "1 year": 1.0,
    "2 years": 2.0,
    "3 years": 3.0,
    "4 years": 4.0,
    "5 years": 5.0,
    "6 years": 6.0,
    "7 years": 7.0,
    "8 years": 8.0,
    "9 years": 9.0,
    "10+ years": 10.0,
}

# Cell texts read as missing.
NULL_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
NUMBER = rf"^{_NUMBER}\z"
# The same with white space around it, and with percent signs after it.
_SPACE = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]*"
SPACED_NUMBER = rf"^{_SPACE}{_NUMBER}{_SPACE}\z"
SPACED_PERCENT = rf"^{_SPACE}{_NUMBER}{_SPACE}%*{_SPACE}\z"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NULL_SPELLINGS), text)


def number(text: Column, percent: bool = False) -> Column:
    """The cast itself passes over plain blanks, so only a text it cannot read as it stands is stripped."""
    plain, cleaned = text, strip(text)
    if percent:
        plain, cleaned = F.rtrim(text, F.lit("%")), strip(F.rtrim(cleaned, F.lit("%")))
    value = F.coalesce(plain.try_cast("double"), cleaned.try_cast("double"))
    return F.when(text.rlike(SPACED_PERCENT if percent else SPACED_NUMBER), value)


def lenient_number(text: Column) -> Column:
    """Percent signs are always allowed; used when exploring raw data."""
    return number(text, percent=True)


def month_start(text: Column) -> Column:
    """``'Dec-2011'`` -> ``DATE '2011-12-01'``."""
    return F.when(text.rlike(r"^[A-Za-z]{3}-[0-9]{4}\z"), F.try_to_date(text, "MMM-yyyy"))


def employment_years(text: Column) -> Column:
    pairs = [F.lit(item) for pair in EMPLOYMENT_YEARS.items() for item in pair]
    return F.create_map(*pairs)[text]


def all_digits(text: Column) -> Column:
    return text.rlike(r"^[0-9]+\z")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
