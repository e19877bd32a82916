"""Numbers and dates as text for people. One value on the driver, and columns.

Fixed-point digits round the exact binary value half up (away from zero), whole numbers half
towards positive infinity. Missing or non-finite values are an em dash; minus is U+2212 where a
sign is always shown.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "—"
MINUS = "−"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def missing(v: float | None) -> bool:
    return v is None or not math.isfinite(v)


def fixed(v: float, digits: int) -> str:
    text = str(Decimal(abs(v)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))
    return f"-{text}" if v < 0 else text


def whole(v: float) -> int:
    return math.floor(v + 0.5)


def _signed(v: float, text: str) -> str:
    return f"{'+' if v >= 0 else MINUS}{text}"


def percent(v: float | None, digits: int = 1) -> str:
    return EMPTY if missing(v) else _signed(v, f"{fixed(abs(v * 100), digits)}%")


def percent_plain(v: float | None, digits: int = 1) -> str:
    return EMPTY if missing(v) else f"{fixed(v * 100, digits)}%"


def ratio(v: float | None, digits: int = 2) -> str:
    return EMPTY if missing(v) else fixed(v, digits)


def signed_ratio(v: float | None, digits: int = 2) -> str:
    return EMPTY if missing(v) else _signed(v, fixed(abs(v), digits))


def integer(v: float | None) -> str:
    return EMPTY if missing(v) else f"{whole(v):,}"


def signed_integer(v: float | None) -> str:
    if missing(v):
        return EMPTY
    n = whole(v)
    return "0" if n == 0 else _signed(n, str(abs(n)))


def cash(v: float | None) -> str:
    return EMPTY if missing(v) else f"${whole(v):,}"


def price(v: float | None) -> str:
    if missing(v):
        return EMPTY
    units, _, cents = fixed(abs(v), 2).partition(".")
    return f"{'-' if v < 0 else ''}{int(units):,}.{cents}"


def market_cap(v: float | None) -> str:
    if missing(v) or v <= 0:
        return EMPTY
    for unit, letter in ((1e12, "T"), (1e9, "B")):
        if v >= unit:
            digits = 2 if letter == "T" else 0 if v / unit >= 100 else 1
            return f"${fixed(v / unit, digits)}{letter}"
    return f"${fixed(v / 1e6, 0)}M"


def sign(v: float | None) -> int:
    return 0 if missing(v) or v == 0 else 1 if v > 0 else -1


def iso_to_display(iso: str | None) -> str:
    """2026-08-18 as 18 Aug 2026; what is no such date stays."""
    if not iso:
        return EMPTY
    parts = iso.split("-")
    if len(parts) < 3 or not all(parts[:3]):
        return iso
    y, m, d = parts[:3]
    month = MONTHS[int(m) - 1] if m.isdigit() and 1 <= int(m) <= 12 else m
    return f"{int(d) if d.isdigit() else d} {month} {y}"


def spread(v: float | None, digits: int = 1) -> str:
    """A width: the percentage without a sign."""
    return EMPTY if missing(v) else f"{fixed(abs(v * 100), digits)}%"


def meter_position(from_high: float) -> float:
    """Place on a meter from 75 % to 100 % of the high, in percent."""
    return min(1.0, max(0.0, (from_high - 0.75) / 0.25)) * 100


def scope(segment_name: str | None, sector: str | None, query: str, watchlist_only: bool, total: int, everything: str) -> str:
    """What a ranking is over, in words."""
    first = "the watchlist" if watchlist_only else f"the {segment_name}" if segment_name else everything
    parts = [first] + ([sector] if sector else []) + ([f"matching “{query.strip()}”"] if query.strip() else [])
    return f"{', '.join(parts)} — {total} name{'' if total == 1 else 's'}"


# The same over columns, as Catalyst expressions.


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _or_empty(c: Column, shown: Column) -> Column:
    return F.when(_known(c), shown).otherwise(EMPTY)


def _digits(size: Column, digits: int, commas: bool = False) -> Column:
    """A value of zero or more in fixed-point digits.

    format_number rounds the exact binary value, ties to even; a tie is an odd multiple of
    2 ** -(digits + 1), and is lifted a little here to go up.
    """
    tie = (size * float(2 ** (digits + 1))) % 2 == 1
    text = F.format_number(F.when(tie, size + 10.0 ** -(digits + 2)).otherwise(size), digits)
    return text if commas else F.translate(text, ",", "")


def _with_minus(c: Column, text: Column) -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), text)


def _with_sign(c: Column, text: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(MINUS), text)


def percent_column(c: Column, digits: int = 1) -> Column:
    return _or_empty(c, _with_sign(c, F.concat(_digits(F.abs(c * 100), digits), F.lit("%"))))


def percent_plain_column(c: Column, digits: int = 1) -> Column:
    return _or_empty(c, _with_minus(c, F.concat(_digits(F.abs(c * 100), digits), F.lit("%"))))


def spread_column(c: Column, digits: int = 1) -> Column:
    return percent_plain_column(F.abs(c), digits)


def ratio_column(c: Column, digits: int = 2) -> Column:
    return _or_empty(c, _with_minus(c, _digits(F.abs(c), digits)))


def signed_ratio_column(c: Column, digits: int = 2) -> Column:
    return _or_empty(c, _with_sign(c, _digits(F.abs(c), digits)))


def integer_column(c: Column) -> Column:
    return _or_empty(c, F.format_number(F.floor(c + 0.5), 0))


def signed_integer_column(c: Column) -> Column:
    n = F.floor(c + 0.5)
    return _or_empty(c, F.when(n == 0, "0").otherwise(_with_sign(c, F.abs(n).cast("string"))))


def cash_column(c: Column) -> Column:
    return _or_empty(c, F.concat(F.lit("$"), integer_column(c)))


def price_column(c: Column) -> Column:
    return _or_empty(c, _with_minus(c, _digits(F.abs(c), 2, commas=True)))


def market_cap_column(c: Column) -> Column:
    unit = lambda size, digits, letter: F.concat(F.lit("$"), _digits(c / size, digits), F.lit(letter))
    shown = F.when(c >= 1e12, unit(1e12, 2, "T")).when(c >= 1e11, unit(1e9, 0, "B")).when(c >= 1e9, unit(1e9, 1, "B")).otherwise(unit(1e6, 0, "M"))
    return _or_empty(F.when(c > 0, c), shown)


def meter_column(from_high: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (from_high - 0.75) / 0.25)) * 100


def sign_column(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0).otherwise(F.coalesce(F.signum(c), F.lit(0.0))).cast("int")


def display_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "d MMM yyyy"), F.lit(EMPTY))
