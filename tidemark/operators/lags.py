"""Lag, difference and trailing features within a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_features(
    df: DataFrame, keys: Sequence[str], lags: Sequence[int], at: str = "date", value: str = "qty", by: str = "row"
) -> DataFrame:
    """``<value>_lag_<k>`` for each k, from one window.

    ``by="row"``: the k-th earlier row of the series. ``by="day"``: the row dated exactly k days earlier, NULL where
    there is none; ``at`` must then be unique in a series.
    """
    series = Window.partitionBy(*keys)
    if by == "row":
        ordered = series.orderBy(at)
        new = {f"{value}_lag_{k}": F.lag(value, k).over(ordered) for k in lags}
    elif by == "day":
        ordered = series.orderBy(F.unix_date(at))
        new = {f"{value}_lag_{k}": F.first(value).over(ordered.rangeBetween(-k, -k)) for k in lags}
    else:
        raise ValueError(f"by must be 'row' or 'day', not {by!r}")
    return df.withColumns(new)


def first_difference(df: DataFrame, keys: Sequence[str], at: str = "date", value: str = "qty") -> DataFrame:
    """``<value>_diff``: the change from the row before, NULL on a series' first row."""
    before = F.lag(value, 1).over(Window.partitionBy(*keys).orderBy(at))
    return df.withColumn(f"{value}_diff", F.col(value) - before)


def _running(df: DataFrame, keys: Sequence[str], at: str, value: str):
    """``df`` with the running total ``_sum``, and a function giving the total up to ``shift`` days from each row.

    A total over any span of days is a difference of two running totals. These frames only ever grow, so the cost of
    a row does not depend on the length of the span; decimals stay exact.
    """
    ordered = Window.partitionBy(*keys).orderBy(F.unix_date(at))
    zero = F.lit(0).cast(df.schema[value].dataType)
    total = F.sum(F.coalesce(F.col(value), zero)).over(ordered.rangeBetween(Window.unboundedPreceding, 0))

    def up_to(shift):
        reached = F.last("_sum").over(ordered.rangeBetween(Window.unboundedPreceding, shift))
        return F.coalesce(reached.cast("double"), F.lit(0.0)) if shift else F.col("_sum").cast("double")

    return df.withColumn("_sum", total), up_to


def trailing_means(
    df: DataFrame, keys: Sequence[str], days: Sequence[int], at: str = "date", value: str = "qty"
) -> DataFrame:
    """``<value>_mean_<d>``: total of the ``d`` days up to and including the row's, over ``d``."""
    rows, up_to = _running(df, keys, at, value)
    return rows.withColumns({f"{value}_mean_{d}": (up_to(0) - up_to(-d)) / d for d in days}).drop("_sum")


def demand_ahead(
    df: DataFrame, keys: Sequence[str], days: Sequence[int], at: str = "date", value: str = "qty"
) -> DataFrame:
    """``<value>_next_<d>``: total of the ``d`` days after the row's; days without a row count as zero."""
    rows, up_to = _running(df, keys, at, value)
    return rows.withColumns({f"{value}_next_{d}": up_to(d) - up_to(0) for d in days}).drop("_sum")
