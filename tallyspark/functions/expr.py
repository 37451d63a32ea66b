"""Column helpers shared by all operators.  Everything here returns a
built-in Column expression (JVM side, whole-stage codegen); no Python UDF.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY

# Fixed values of the reporting layer (must equal the reference's).
LOW_AND_SOON = "Low stock and likely to run out within 3 days"
LOW_ONLY = "Stock is at or below the low-stock threshold"
SOON_ONLY = "Likely to run out within 3 days"
CURRENCY_SUFFIX = " MAD"
DELETED_PRODUCT = "Deleted product"
UNNAMED_SHOP = "Unnamed shop"
SOON_DAYS = 3
# Fixed value: the characters that Python's ``str.strip`` removes.
WHITE_SPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WINDOW_DAYS = 7


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(value: str) -> Column:
    """An exact decimal literal (a Python float literal would be a double)."""
    return F.lit(Decimal(value))


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def to_double(c: str | Column) -> Column:
    return col(c).cast("double")


def date_lit(d: date | str) -> Column:
    return F.lit(d if isinstance(d, date) else date.fromisoformat(d)).cast("date")


def py_round1(c: str | Column) -> Column:
    """Round a double to 1 decimal exactly like Python's ``round(x, 1)``.

    ``format_number`` rounds half-even on the exact binary value, which is what
    Python does; ``F.round``/``F.bround`` round the shortest decimal text instead.
    """
    return F.regexp_replace(F.format_number(col(c), 1), ",", "").cast("double")


def money_text(c: str | Column) -> Column:
    """``1,234.50 MAD`` (thousands separator, 2 decimals).

    Formats the value at its own precision: per-shop sums are wider than
    ``decimal(12,2)`` and would overflow a narrowing cast.
    """
    return F.concat(F.format_number(col(c), 2), F.lit(CURRENCY_SUFFIX))


def safe_iso_date(c: str | Column) -> Column:
    """ISO text to date; anything else becomes null instead of an ANSI error."""
    return F.try_to_date(col(c), "yyyy-MM-dd")


def strip(c: str | Column) -> Column:
    """Leading and trailing white space removed, as Python's ``str.strip`` does."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: str | Column) -> Column:
    return col(c).isNull() | (strip(c) == "")


def violated(cond: Column) -> Column:
    """A rule's "bad" condition, where null counts as bad."""
    return F.coalesce(cond, F.lit(True))


def name_key(c: str | Column) -> Column:
    """Case-insensitive matching key for product and customer names."""
    return F.lower(strip(c))


def reasons(*rules: tuple[Column, str]) -> Column:
    """All violated rule codes, in rule order (empty array = valid)."""
    checks = [F.when(cond, F.lit(code)) for cond, code in rules]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def coerce_money(c: str | Column) -> Column:
    """Text or number to money; unparsable → 0 (hosted-path coercion)."""
    return F.coalesce(strip(col(c).cast("string")).try_cast(MONEY), dec("0.00"))


def coerce_int(c: str | Column) -> Column:
    """Text or number to an integer: any number is cut toward zero, what is none becomes 0."""
    number = strip(col(c).cast("string")).try_cast("double")
    return F.coalesce(number.try_cast("int"), F.lit(0))
