"""Category indexes as tables, for columns of any width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import freeze

# monotonically_increasing_id keeps the partition number above this bit and the row number below it
_ROW_BITS = 33


def running_totals(df: DataFrame, within: Sequence[str], order: Sequence, column: str, name: str) -> DataFrame:
    """The total of ``column`` up to and with each row, in ``order`` within each ``within`` group, whatever its size.

    Like :func:`number_rows`: sums within the slices of a distributed sort, plus the totals of earlier slices (one row per
    slice), minus those of earlier groups (one row per group). ``column`` holds whole numbers, none NULL.
    """
    slices = freeze(df.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id()))
    slices = slices.withColumn("_slice", F.shiftright("_at", _ROW_BITS))
    sizes = slices.groupBy("_slice").agg(F.sum(column).alias("_sum"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    here = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        slices.withColumn("_here", F.sum(column).over(here))
        .join(F.broadcast(offsets), "_slice")  # one row per partition of the sort
        .withColumn("_upto", F.col("_offset") + F.col("_here"))
    )
    starts = ranked.groupBy(*within).agg(F.min(F.col("_upto") - F.col(column)).alias("_start"))
    return (
        ranked.join(starts, list(within))
        .withColumn(name, F.col("_upto") - F.col("_start"))
        .drop("_at", "_slice", "_offset", "_here", "_upto", "_start")
    )


def number_rows(df: DataFrame, within: Sequence[str], order: Sequence, name: str = "idx") -> DataFrame:
    """Rows numbered from 0 in ``order`` within each ``within`` group, whatever the size of a group.

    A row_number window would sort a whole group in one task. Here a distributed sort lays the rows out in slices,
    the slices are frozen, and a row's number is its place in its slice plus the rows of earlier slices (a table
    with one row per slice) minus the rows of earlier groups (one row per group).
    """
    slices = freeze(df.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id()))
    slice_no = F.shiftright("_at", _ROW_BITS)
    sizes = slices.groupBy(slice_no.alias("_slice")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ranked = (
        slices.withColumn("_slice", slice_no)
        .join(F.broadcast(offsets), "_slice")  # one row per partition of the sort
        .withColumn("_rank", F.col("_offset") + place)
    )
    if not within:
        return ranked.withColumn(name, F.col("_rank")).drop("_at", "_slice", "_offset", "_rank")
    starts = ranked.groupBy(*within).agg(F.min("_rank").alias("_first"))
    return (
        ranked.join(starts, list(within))
        .withColumn(name, F.col("_rank") - F.col("_first"))
        .drop("_at", "_slice", "_offset", "_rank", "_first")
    )


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, n, idx)``: each column's values numbered from 0, most frequent first, ties by value."""
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
            )
        )
    ).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return number_rows(counts, ["feature"], [F.desc("n"), "value"])


def one_hot_slots(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, feature, slot)``: the position that is 1 in each row's one-hot vector.

    The last category has no position of its own (slot NULL, an all-zero vector). Columns with one value have no
    vector and are left out.
    """
    index = category_index(df, columns)
    widths = index.groupBy("feature").agg(F.count("*").alias("_width")).where("_width > 1")
    long = df.select(
        key,
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
            )
        ),
    )
    return (
        long.join(index, ["feature", "value"])
        .join(F.broadcast(widths), "feature")  # one row per column
        .select(key, "feature", F.when(F.col("idx") < F.col("_width") - 1, F.col("idx")).alias("slot"))
    )
