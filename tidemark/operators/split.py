"""Chronological train / test split and rolling folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_per_day(panel: DataFrame, measure: str = "qty") -> DataFrame:
    """Panel rows per day.

    Counted as rows with plus rows without a measure: reading the measure keeps the aggregate below identical to the
    panel's own, so Spark runs its scan and shuffle once for both.
    """
    return panel.groupBy("date").agg((F.count(measure) + F.count_if(F.col(measure).isNull())).alias("n"))


def split_cutoff(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """One row: ``cutoff``, the last date whose percent rank among all panel rows is at most ``share``; ``n_rows``.

    The percent rank of a row is the number of rows on earlier days over ``n_rows - 1``. It is the same for all rows
    of a day, so it is found on the table of days. That table has a row per calendar day however large the panel
    is, which bounds the one-partition window here.
    """
    days = rows_per_day(panel)
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    ranked = days.select(
        "date",
        "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("n_rows"),
    )
    in_train = (F.col("n_rows") == 1) | (
        F.try_divide(F.col("before").cast("double"), (F.col("n_rows") - 1).cast("double")) <= F.lit(float(share))
    )
    return ranked.agg(
        F.max(F.when(in_train, F.col("date"))).alias("cutoff"),
        F.max("n_rows").alias("n_rows"),
    )


def _train_condition(panel: DataFrame, share: float) -> Column:
    cutoff = split_cutoff(panel, share).select("cutoff").scalar()
    # undated rows rank first, so they belong to train
    return F.col("date").isNull() | (F.col("date") <= cutoff)


def flag_split(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """The panel with ``is_train``; both halves from one pass."""
    return panel.withColumn("is_train", _train_condition(panel, share))


def chrono_split(panel: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(train, test) as date filters, which reach the scan of a table with a date column."""
    condition = _train_condition(panel, share)
    return panel.where(condition), panel.where(~condition)


def fold_bounds(panel: DataFrame, n_folds: int, test_days: int, gap_days: int = 0) -> DataFrame:
    """Rolling folds, the last one ending on the last day of the panel.

    Columns ``fold`` (1 is the oldest), ``train_end``, ``test_start``, ``test_end``. Test windows follow each other
    without overlap; ``gap_days`` days between train and test are used by neither.
    """
    last = panel.agg(F.max("date").alias("last"))
    back = (F.lit(n_folds) - F.col("fold")) * test_days
    return (
        last.select("last", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
        .withColumn("test_end", F.date_sub("last", back))
        .withColumn("test_start", F.date_sub("test_end", F.lit(test_days - 1)))
        .withColumn("train_end", F.date_sub("test_start", F.lit(gap_days + 1)))
        .select("fold", "train_end", "test_start", "test_end")
    )
