"""The seasonal-mean baseline: mean daily quantity per month, store and product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.functions.numbers import exact_mean
from tidemark.operators.split import flag_split
from tidemark.operators.stats import rmse

LOOKBACK_MONTHS = {"year_month": 0, "seasonal": 12}
FIT_KEYS = ("month_start", "store_id", "product_id")


def fit_panel(panel: DataFrame) -> DataFrame:
    """``prediction`` per (year, month, store, product): the mean over days that have a panel row."""
    return (
        panel.groupBy(month_start(F.col("date")).alias("month_start"), "store_id", "product_id")
        .agg(exact_mean(F.col("qty")).alias("prediction"))
        .select(
            F.year("month_start").alias("year"), F.month("month_start").alias("month"), *FIT_KEYS, "prediction"
        )
    )


def day_bits(day: Column, counted: Column) -> Column:
    """Aggregate: the days of a month on which ``counted`` holds, one bit per day."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(day))
    return F.bit_or(F.when(counted, bit))


def fit_sales(
    sales: DataFrame, zero_fill: bool = False, observed: tuple[Column, Column] | None = None
) -> DataFrame:
    """The same fit straight from sales rows, in one shuffle instead of the panel's and the fit's.

    A mean of daily sums is the month's sum over the number of days with sales. The days are kept as a bit mask,
    which merges before the shuffle like the sum does. ``zero_fill`` counts days without a sale as zero: it divides by
    the days of the month that were observed, from ``observed[0]`` to ``observed[1]`` (default: the first and last date
    of ``sales``).
    """
    sold = F.col("qty").isNotNull()
    masked = sales.groupBy(month_start(F.col("date")).alias("month_start"), "store_id", "product_id").agg(
        F.sum("qty").alias("_total"), day_bits(F.col("date"), sold).alias("_days")
    )
    if zero_fill:
        first, last = observed or (sales.agg(F.min("date")).scalar(), sales.agg(F.max("date")).scalar())
        begin, end = F.greatest("month_start", first), F.least(F.last_day("month_start"), last)
        days = F.datediff(end, begin) + 1
    else:
        days = F.bit_count("_days")
    return masked.select(*FIT_KEYS, F.try_divide(F.col("_total").cast("double"), days.cast("double")).alias("prediction"))


def apply_fit(rows: DataFrame, fit: DataFrame, key: str = "year_month", how: str = "left") -> DataFrame:
    """Add ``prediction`` to any rows with ``date, store_id, product_id``, from a fit table of :func:`fit_panel`.

    ``key="year_month"`` looks up the row's own month, ``"seasonal"`` the month a year before. ``how="left"`` keeps rows
    without a fit (NULL), ``"inner"`` leaves them out.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    asked = F.add_months(month_start(F.col("date")), -LOOKBACK_MONTHS[key])
    found = fit.select(*FIT_KEYS, "prediction")
    return rows.withColumn("month_start", asked).join(found, list(FIT_KEYS), how).select(*rows.columns, "prediction")


def predict(panel: DataFrame, key: str = "year_month") -> DataFrame:
    """Add ``prediction`` and ``matched`` to a panel that has ``is_train``.

    The prediction is the mean of the *train* rows of the same store and product in the same month
    (``key="year_month"``) or the month a year before (``"seasonal"``). ``matched`` says whether any such row exists.
    A fit table joined back on its keys gives the same rows; the window form shuffles the panel once and needs no
    second table. A (month, store, product) group has at most 31 rows, a (store, product) group one per day.
    """
    back = LOOKBACK_MONTHS[key]
    panel = panel.withColumn("month_start", month_start(F.col("date")))
    if back:
        month_no = F.year("month_start") * 12 + F.month("month_start")
        frame = Window.partitionBy("store_id", "product_id").orderBy(month_no).rangeBetween(-back, -back)
    else:
        frame = Window.partitionBy(*FIT_KEYS)
    train_qty = F.when(F.col("is_train"), F.col("qty"))
    total = F.sum(train_qty).over(frame).cast("double")
    present = F.col("date").isNotNull() & F.col("store_id").isNotNull() & F.col("product_id").isNotNull()
    return panel.withColumns(
        {
            "prediction": F.when(present, F.try_divide(total, F.count(train_qty).over(frame).cast("double"))),
            "matched": present & (F.count(F.when(F.col("is_train"), F.lit(1))).over(frame) > 0),
        }
    )


def predictions(panel: DataFrame, share: float = 0.8, key: str = "year_month") -> DataFrame:
    """Split the panel by time, fit on train, and score both parts; rows without a fit are kept and not matched."""
    return predict(flag_split(panel, share), key)


def scores(predicted: DataFrame) -> DataFrame:
    """RMSE per split with the coverage: ``n_rows`` in the split, ``n_scored`` of them with a fit."""
    split = F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test"))
    return rmse(predicted.withColumn("split", split), "qty", "prediction", ["split"]).withColumn(
        "coverage", F.col("n_scored") / F.col("n_rows")
    )
