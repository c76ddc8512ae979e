"""Panel and fit kept as tables by month, and brought up to date by the days that are new or corrected.

A month's fit follows from that month's panel alone, so new days touch their own months and no others: those months are
merged with what is stored, and their partitions replaced by dynamic overwrite. The rest of the history is neither read
nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.operators.panel import daily_panel
from tidemark.plans.baseline import fit_panel
from tidemark.runtime import session_options, stage, working

MODES = ("replace", "add")


def _write_months(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the months in ``df``; other months stay as they are."""
    with session_options(df.sparkSession, spark__sql__sources__partitionOverwriteMode="dynamic"):
        df.repartition("month_start").sortWithinPartitions("month_start").write.mode("overwrite").partitionBy("month_start").parquet(path)


def create(sales: DataFrame, folder: str) -> None:
    """Writes the whole panel and fit of ``sales`` under ``folder``, by month. Rows without a date are left out."""
    rows = daily_panel(sales.where("date IS NOT NULL")).withColumn("month_start", month_start(F.col("date")))
    with working():
        rows = stage(rows, "panel-months")
        _write_months(rows, f"{folder}/panel")
        _write_months(fit_panel(rows.drop("month_start")), f"{folder}/fit")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The stored panel, one row per (date, store, product)."""
    return spark.read.parquet(f"{folder}/panel").select("date", "store_id", "product_id", "qty")


def fit(spark: SparkSession, folder: str) -> DataFrame:
    """The stored fit, as :func:`tidemark.plans.baseline.fit_panel` makes it."""
    stored = spark.read.parquet(f"{folder}/fit")
    return stored.select("year", "month", F.col("month_start").cast("date").alias("month_start"), "store_id", "product_id", "prediction")


def refresh(sales: DataFrame, folder: str, mode: str = "replace") -> list:
    """Merges rows of sales into the stored panel and fit; returns the months that were rewritten, in order.

    ``mode="replace"``: each date in ``sales`` is delivered whole and replaces what is stored of it, so corrected days
    come out right. ``"add"``: the rows are late ones and add to what is stored. Only the months of the dates in ``sales``
    are read and written. The rows are staged before their months are replaced, so a run that fails before that leaves
    the tables as they were, and one repeated in mode ``replace`` ends with the same tables. Rows without a date are left
    out; no rows change nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    spark = sales.sparkSession
    with working():
        new = daily_panel(sales.where("date IS NOT NULL")).withColumn("month_start", month_start(F.col("date")))
        new = stage(new, "new-days")
        months = sorted(r[0] for r in new.select("month_start").distinct().collect())  # bounded by the calendar
        if not months:
            return []
        stored = spark.read.parquet(f"{folder}/panel").where(F.col("month_start").isin(months)).select(*new.columns)
        if mode == "replace":
            kept = stored.join(new.select("date").distinct(), "date", "left_anti").select(*new.columns)
            merged = kept.unionByName(new)
        else:
            merged = daily_panel(stored.unionByName(new)).withColumn("month_start", month_start(F.col("date")))
        merged = merged.withColumn("qty", F.col("qty").cast(new.schema["qty"].dataType))
        merged = stage(merged, "merged-months")
        _write_months(merged, f"{folder}/panel")
        _write_months(fit_panel(merged.drop("month_start")), f"{folder}/fit")
    return months
