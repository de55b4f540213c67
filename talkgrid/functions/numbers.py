"""Numbers from loose values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value as a number is neither missing nor infinite."""
    x = value.try_cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def number(value: Column, default: float = 0.0) -> Column:
    """The value as a finite number, or default."""
    return F.when(finite(value), value.try_cast("double")).otherwise(F.lit(default))


def half_even(x: Column, places: int = 0) -> Column:
    """Rounded with halves to even, by the decimal digits of x."""
    return F.bround(x, places)


def label_ok(label: Column) -> Column:
    """A name that may be given: not blank, at most 80 characters, none of them a control character."""
    return F.coalesce((F.trim(label) != "") & (F.length(label) <= 80) & ~label.rlike(r"[\x00-\x1f]"), F.lit(False))
