"""Number parsing and exact means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QTY_TYPE = "decimal(12,2)"


def decimal_comma(name: str, to: str = "double", thousands: str | None = None, strict: bool = False) -> Column:
    """Text such as ``'12,5'`` as a number, by default a double; a decimal type rounds to its digits.

    Text that is no number becomes NULL, or fails the query with ``strict``. ``thousands`` names a grouping mark
    to remove first; without it ``'1.234,56'`` is no number.
    """
    # the comma becomes a point; a grouping mark has no counterpart and is dropped
    text = F.translate(name, "," + (thousands or ""), ".")
    return text.cast(to) if strict else text.try_cast(to)


def exact_mean(value: Column) -> Column:
    """Mean of a decimal column: the sum is exact, so the result does not depend on row order or retries."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits)
