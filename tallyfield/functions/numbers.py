"""Numbers and money: parsing of written forms, exact shares, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, bound, clean

MINOR = "decimal(20,0)"


def loose_number(text: Column) -> Column:
    """The ledger's notion: blanks go, the first comma is a point, and a numeric prefix counts."""
    plain = F.regexp_replace(blank_to_null(text), r"\s", "")
    pointed = F.regexp_replace(plain, r"^([^,]*),", "$1.")
    prefix = F.regexp_extract(pointed, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return F.nullif(prefix, F.lit("")).try_cast("double")  # the cast of an empty text would fail at the price of an exception


def loose_int(text: Column) -> Column:
    """A loose number, half rounded up."""
    return F.floor(loose_number(text) + 0.5)


def decimal_text(text: Column) -> Column:
    """A written number as [-]digits[.digits], or null.

    Of two kinds of separators the last is the decimal mark; a single separator is one too; one
    kind that repeats only groups digits.
    """
    kept = F.regexp_replace(clean(text), r"[^\d.,+-]", "")
    return bound(kept, lambda k: bound(F.regexp_replace(k, "^[+-]", ""), lambda body: _decimal(k.startswith("-"), body)))


def _decimal(negative: Column, body: Column) -> Column:
    points, commas = (F.length(body) - F.length(F.translate(body, mark, "")) for mark in ".,")
    digits = F.translate(body, ".,", "")
    after = F.regexp_extract(body, "[.,]([^.,]*)$", 1)
    has_mark = ((points > 0) & (commas > 0)) | (points + commas == 1)
    # the last separator is the mark, and what stands before it only groups
    cut = F.length(digits) - F.length(after)
    whole = F.when(has_mark, F.substring(digits, F.lit(1), cut)).otherwise(digits)
    number = F.concat(
        F.when(negative, "-").otherwise(""), F.when(whole == "", "0").otherwise(whole), F.when(has_mark & (after != ""), F.concat(F.lit("."), after)).otherwise("")
    )
    return F.when(digits.rlike(r"^\d+$"), number)


def number(text: Column) -> Column:
    return decimal_text(text).try_cast("double")


def minor_units(text: Column) -> Column:
    """Money in hundredths, exact; a third decimal is rounded half away from zero."""
    return (F.round(decimal_text(text).try_cast("decimal(38,6)"), 2) * 100).cast(MINOR)


def percent_of(minor: Column, pct: int) -> Column:
    """A share of an exact amount, half away from zero."""
    return F.round(minor.cast(MINOR) * pct / 100, 0).cast(MINOR)


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is null where the denominator is null, zero or below."""
    return numerator / F.when(denominator > 0, denominator)


def kilograms(value: Column) -> Column:
    """An exact weight to the gram."""
    return value.cast("decimal(18,3)")


def tons(kg: Column) -> Column:
    return kg / 1000


def grouped(value: Column, digits: int = 2) -> Column:
    """A number for display: blanks between groups, a comma before decimals."""
    return F.translate(F.format_number(value, digits), ",.", " ,")


def clamp_pct(pct: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), pct))


def axis_step(top: Column, ticks: int = 5) -> Column:
    """A round step of 1, 2, 2.5, 5 or 10 times a power of ten, so that `ticks` of them reach top."""
    raw = top / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    share = raw / power
    step = F.when(share <= 1, 1.0).when(share <= 2, 2.0).when(share <= 2.5, 2.5).when(share <= 5, 5.0).otherwise(10.0)
    return F.when(top > 0, step * power).otherwise(1.0)
