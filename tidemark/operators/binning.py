"""Target-ordered bins, so that trees can split categories of any width by a bounded number of slots.

For squared error the best two-way split of a category is a cut through its values in order of their mean target. Values in
that order are cut into a fixed number of bins of equal weight, which trees then take as ordered numbers: their statistics
have a cell per bin, however many values there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.encoders import TableEncoder, fit_slots
from tidemark.operators.indexing import running_totals
from tidemark.runtime import stage

BINS = 256


def category_means(rows: DataFrame, columns: Sequence[str], target: str, weight: Column | None = None) -> DataFrame:
    """``(feature, value, n, total)``: rows and summed target of each value; sums merge before the shuffle.

    With ``weight`` a row stands for so many and ``target`` is their sum. NULL values are left out.
    """
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    n = F.lit(1).cast("long") if weight is None else weight
    long = rows.select(F.inline(F.array(*cells)), n.alias("_n"), F.col(target).alias("_y")).where("value IS NOT NULL")
    return long.groupBy("feature", "value").agg(F.sum("_n").alias("n"), F.sum("_y").alias("total"))


def target_bins(means: DataFrame, bins: int = BINS) -> DataFrame:
    """``(feature, value, n, mean, bin)`` from :func:`category_means`: values by mean target, ties by value, in ``bins`` parts.

    A value's bin is the part of the feature's rows that lie before it, times ``bins``, rounded down, so bins hold equal
    shares of rows except where one value alone holds more; bins in between are then empty. Values without a target
    (NULL sums) come first. Numbered by a distributed sort, not by a window over all values.
    """
    mean = F.try_divide(F.col("total").cast("double"), F.col("n").cast("double"))
    ranked = running_totals(means.withColumn("mean", mean), ["feature"], ["mean", "value"], "n", "upto")
    sizes = means.groupBy("feature").agg(F.sum("n").alias("_all"))
    at = F.floor((F.col("upto") - F.col("n")) * bins / F.col("_all"))
    return ranked.join(sizes, "feature").select(  # one row a column
        "feature", "value", "n", "mean", F.least(at, F.lit(bins - 1)).cast("int").alias("bin")
    )


def fit_bins(means: DataFrame, bins: int = BINS, suffix: str = "_bin") -> TableEncoder:
    """An encoder of the values to their bins. Unseen values take the highest bin whose mean is at most the overall one."""
    table = stage(target_bins(means, bins), "bins")
    overall = F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("_mean")
    of_all = table.groupBy("feature").agg(overall, F.max("bin").alias("_last"))
    middle = table.join(of_all, "feature").groupBy("feature").agg(
        F.max(F.when(F.col("mean") <= F.col("_mean"), F.col("bin"))).alias("default"), F.first("_last").alias("last")
    )
    found = {r.feature: (r.last + 1, r.default or 0) for r in middle.collect()}  # a row a column
    slots = table.select("feature", "value", F.col("bin").alias("slot"))
    return fit_slots(slots, {c: w for c, (w, _) in found.items()}, {c: d for c, (_, d) in found.items()}, suffix)
