"""Global positions and running totals of ordered rows, without a one-task window.

Rows are dealt into ranges of the order, sorted within each range and written once with the range's number. A range's
offset is the total of the ranges before it: one row per range, so that small table may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import stage

BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def ordered(df: DataFrame, order: Sequence[Column | str], label: str) -> DataFrame:
    """``df`` written in the given order, with ``_part`` (number of the range) and ``_row`` (row within it)."""
    at = F.monotonically_increasing_id()
    return stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", at)
        .withColumns({"_part": F.shiftright("_at", BITS), "_row": F.col("_at").bitwiseAND((1 << BITS) - 1)})
        .drop("_at"),
        label,
    )


def _offsets(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per range, the totals of all ranges before it."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(*[e.alias(f"_sum_{n}") for n, e in sums.items()])
    return parts.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])


def with_position(rows: DataFrame, name: str = "position") -> DataFrame:
    """Adds each row's place, from 0, in the order of :func:`ordered`."""
    offsets = _offsets(rows, {"n": F.count(F.lit(1))})
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off_n") + F.col("_row")).drop("_off_n")


def with_running(rows: DataFrame, column: str, name: str = "upto") -> DataFrame:
    """Adds the total of ``column`` up to and with each row, in the order of :func:`ordered`."""
    within = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    offsets = _offsets(rows, {"s": F.sum(column)})
    return (
        rows.withColumn("_within", F.sum(column).over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off_s") + F.col("_within"))
        .drop("_off_s", "_within")
    )
