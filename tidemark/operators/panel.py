"""Totals, the daily store x product panel, and its enrichment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import date_parts, month_end, month_start, years_open
from tidemark.runtime import stage

SERIES_ROWS = 250_000
PANEL_KEYS = ("date", "store_id", "product_id")


def totals(sales: DataFrame, keys: Mapping[str, Column] | Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum of each measure per key. Partial sums are formed before the shuffle, so a hot key sends one row per task."""
    if not isinstance(keys, Mapping):
        keys = {k: F.col(k) for k in keys}
    return sales.groupBy(*[e.alias(k) for k, e in keys.items()]).agg(*[F.sum(m).alias(m) for m in measures])


def monthly_totals(sales: DataFrame, keys: Sequence[str] = (), measures: Sequence[str] = ("qty",)) -> DataFrame:
    """Totals per month (and further keys), with the last day of the month beside the first."""
    by = {"month_start": month_start(F.col("date"))} | {k: F.col(k) for k in keys}
    return totals(sales, by, measures).withColumn("month_end", month_end(F.col("month_start")))


def by_series(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows dealt by series to partitions of about ``SERIES_ROWS`` rows, however many rows there are.

    For very many short series, whose totals hardly merge before a shuffle: totals by these and further keys and windows
    over a series then follow in place, and a task holds the months of its own series alone. With few long series, totals
    that merge before the shuffle are the better way.
    """
    return sales.repartition(max(16, -(-sales.count() // SERIES_ROWS)), *keys)


def monthly_store_totals(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Monthly quantity per store with the store's columns; stores without a dimension row are left out."""
    return monthly_totals(sales, ["store_id"]).join(stores, "store_id")


def daily_totals(sales: DataFrame, keys: Sequence[str] = (), measures: Sequence[str] = ("qty",)) -> DataFrame:
    return totals(sales, ["date", *keys], measures)


def daily_panel(sales: DataFrame) -> DataFrame:
    """One row per (date, store, product) with the summed quantity."""
    return totals(sales, PANEL_KEYS, ["qty"])


def staged_panel(sales: DataFrame) -> DataFrame:
    """The daily panel written once, for steps that read it several times; each file is in date order."""
    return stage(daily_panel(sales), "panel", sort=["date"])


def enrich(panel: DataFrame, stores: DataFrame, products: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Panel rows with date parts, store and product columns; inner joins on the two keys.

    No hints: Spark broadcasts a dimension that is small by its files or, with adaptive execution, by what it turns out
    to hold, and otherwise sorts, merges and splits oversized partitions.

    ``years_open`` is counted to ``as_of_year``, by default the year of the panel's last date.
    """
    as_of = panel.agg(F.year(F.max("date")).alias("y")).scalar() if as_of_year is None else as_of_year
    stores = stores.withColumn("years_open", years_open("opened_year", as_of))
    rows = panel.withColumns(date_parts(F.col("date")))
    return rows.join(stores, "store_id").join(products, "product_id")


def with_calendar(panel: DataFrame, calendar: DataFrame, on: str = "date") -> DataFrame:
    """Left join of an outside table (holidays, unemployment) by ``date`` or by ``month_start``."""
    if on == "month_start" and on not in panel.columns:
        panel = panel.withColumn(on, month_start(F.col("date")))
    return panel.join(calendar, on, "left")
