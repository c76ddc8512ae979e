"""Time-series operators: calendar completion, seasonal decomposition, autocorrelation.

A series is the rows that share the ``keys`` columns (none: the whole table is one series). Inputs are aggregated
first, so a series has a row per month or day and never more than the calendar has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import period_number, period_step


def fill_calendar(
    df: DataFrame, keys: Sequence[str], at: str, value: str, unit: str = "month", fill: float | None = 0.0
) -> DataFrame:
    """Every period between a series' first and last row; missing ones get ``fill``. Months are given by their first day.

    Each row stands for itself and the periods up to the next row, so this is one window over the series and no join.
    A row without a period belongs nowhere in a calendar, so it fails the query.
    """
    unplaced = F.raise_error(F.lit(f"a row has no {at}")).cast("boolean")
    df = df.where(F.when(F.col(at).isNull(), unplaced).otherwise(True))
    filler = F.lit(fill).cast(df.schema[value].dataType)
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    last_before = F.greatest(F.col(at), F.coalesce(F.date_sub(following, 1), F.col(at)))
    return (
        df.select(*keys, F.col(at).alias("_own"), value, last_before.alias("_until"))
        .withColumn(at, F.explode(F.sequence("_own", "_until", period_step(unit))))
        .select(*keys, at, F.when(F.col(at) == F.col("_own"), F.col(value)).otherwise(filler).alias(value))
    )


def series_issues(
    df: DataFrame,
    keys: Sequence[str],
    at: str = "month_start",
    value: str = "qty",
    period: int = 12,
    model: str = "multiplicative",
    unit: str = "month",
) -> DataFrame:
    """Series that :func:`decompose` would refuse, with the first reason that applies."""
    facts = df.withColumn("_step", _step(keys, at, unit)).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_step") != 1).alias("n_jumps"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.min(value).alias("low"),
    )
    return facts.withColumn("issue", _issue(period, model)).where("issue IS NOT NULL").select(*keys, "n", "issue")


def _step(keys: Sequence[str], at: str, unit: str) -> Column:
    """Periods since the row before, which a complete series has at 1 throughout: a missing period makes it more and a
    repeated one 0, so the two cannot cancel as in a count of rows. The first row has 1; a row without a period has 0."""
    before = Window.partitionBy(*keys).orderBy(F.col(at).asc_nulls_last())
    at_no = period_number(F.col(at), unit)
    step = F.when(F.row_number().over(before) == 1, 1).otherwise(at_no - F.lag(at_no).over(before))
    return F.when(F.col(at).isNull(), 0).otherwise(step)


def _issue(period: int, model: str) -> Column:
    """Why a series with ``n``, ``n_jumps``, ``n_null`` and ``low`` cannot be decomposed; NULL if it can."""
    reason = F.when(F.col("n") < 2 * period, F.lit(f"fewer than {2 * period} rows"))
    reason = reason.when(F.col("n_jumps") > 0, F.lit("periods missing or repeated"))
    reason = reason.when(F.col("n_null") > 0, F.lit("NULL values"))
    if model == "multiplicative":
        reason = reason.when(F.col("low") <= 0, F.lit("zero or negative values in a multiplicative model"))
    return reason


def decompose(
    df: DataFrame,
    keys: Sequence[str] = (),
    at: str = "month_start",
    value: str = "qty",
    period: int = 12,
    model: str = "multiplicative",
    unit: str = "month",
    on_gap: str = "refuse",
    on_refused: str = "raise",
) -> DataFrame:
    """Classical seasonal decomposition: ``trend``, ``seasonal`` and ``resid`` beside each value.

    Trend is the centred moving average over one period (a 2 x period average if the period is even), NULL at both
    ends. Seasonal is the mean detrended value per position in the period, scaled to mean 1 (or shifted to mean 0
    in the additive model). Resid is what is left.

    Positions are counted by row, so gaps matter: ``on_gap="zero"`` fills missing periods with 0, ``"refuse"``
    refuses the series. A refused series (too short, gapped, NULLs, not positive in the multiplicative model) fails
    the query, or is left out whole with ``on_refused="drop"``; :func:`series_issues` lists them.

    All windows are partitioned by the series, so one shuffle serves them all.
    """
    if model not in ("multiplicative", "additive"):
        raise ValueError(f"model must be 'multiplicative' or 'additive', not {model!r}")
    if on_gap not in ("refuse", "zero"):
        raise ValueError(f"on_gap must be 'refuse' or 'zero', not {on_gap!r}")
    if on_refused not in ("raise", "drop"):
        raise ValueError(f"on_refused must be 'raise' or 'drop', not {on_refused!r}")
    times = model == "multiplicative"
    keys = list(keys)
    df = df.select(*keys, at, F.col(value).cast("double").alias(value))
    if on_gap == "zero":
        df = fill_calendar(df, keys, at, value, unit)

    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(at)
    half = period // 2
    y = F.col(value)
    rows = df.withColumn("_step", _step(keys, at, unit)).select(
        *keys,
        at,
        value,
        (F.row_number().over(ordered) - 1).alias("i"),
        F.count("*").over(whole).alias("n"),
        F.count_if(F.col("_step") != 1).over(whole).alias("n_jumps"),
        F.count_if(y.isNull()).over(whole).alias("n_null"),
        F.min(y).over(whole).alias("low"),
        F.sum(y).over(ordered.rowsBetween(-half, half if period % 2 else half - 1)).alias("_left"),
        F.sum(y).over(ordered.rowsBetween(-half if period % 2 else 1 - half, half)).alias("_right"),
    ).withColumn("issue", _issue(period, model))
    inside = (F.col("i") >= half) & (F.col("i") < F.col("n") - half)
    trend = F.when(inside, (F.col("_left") + F.col("_right")) / (2 * period))
    if on_refused == "drop":
        rows = rows.where("issue IS NULL")
    else:
        complaint = F.concat(F.lit("cannot decompose a series: "), F.col("issue"))
        # in a filter, which stays whatever columns the caller goes on with
        rows = rows.where(F.when(F.col("issue").isNotNull(), F.raise_error(complaint).cast("boolean")).otherwise(True))

    detrended = y / F.col("trend") if times else y - F.col("trend")
    rows = (
        rows.withColumn("trend", trend)
        .withColumn("phase", F.col("i") % period)
        .withColumn("_s", F.avg(detrended).over(Window.partitionBy(*keys, "phase")))
    )
    # the first `period` rows hold each position once
    centre = F.sum(F.when(F.col("i") < period, F.col("_s"))).over(whole) / period
    rows = rows.withColumn("seasonal", F.col("_s") / centre if times else F.col("_s") - centre)
    resid = y / (F.col("trend") * F.col("seasonal")) if times else y - F.col("trend") - F.col("seasonal")
    return rows.select(*keys, at, value, "trend", "seasonal", resid.alias("resid"))


def _lag_products(max_lag: int):
    """Column function: for one block, the products summed for each lag 0..max_lag."""

    @F.pandas_udf("array<double>")
    def lag_products(z: pd.Series, n_head: pd.Series) -> pd.Series:
        def one(values, n):
            padded = np.zeros(n + max_lag)
            padded[: len(values)] = values[: n + max_lag]
            return np.correlate(padded, values[:n], "valid")

        return pd.Series([one(np.asarray(v, dtype="float64"), int(n)) for v, n in zip(z, n_head)])

    return lag_products


def autocorrelation(
    df: DataFrame,
    keys: Sequence[str] = (),
    at: str = "date",
    value: str = "qty",
    max_lag: int = 550,
    on_gap: str = "refuse",
    unit: str = "day",
) -> DataFrame:
    """``r`` for lags 1..max_lag of each series with 95 % and 99 % bands.

    A lag is a number of periods, so a series with missing or repeated periods fails the query. ``on_gap="zero"`` fills
    missing ones with 0 first; ``"row"`` counts lags by rows whatever lies between. A NULL value always fails it.

    ``r_h = sum z_i z_(i+h) / sum z_i^2`` with ``z = y - mean``; lags as long as the series or longer do not occur.

    A series is cut into blocks of ``max_lag`` rows. A row goes to its own block and, as a right neighbour, to the
    block before, which then holds every partner within reach. A block holds at most 2 x max_lag numbers whatever
    the length of the series, and sends on one partial sum per lag; no pairs of rows are formed.
    """
    if on_gap not in ("refuse", "zero", "row"):
        raise ValueError(f"on_gap must be 'refuse', 'zero' or 'row', not {on_gap!r}")
    keys = list(keys)
    df = df.select(*keys, at, F.col(value).cast("double").alias(value))
    if on_gap == "zero":
        df = fill_calendar(df, keys, at, value, unit)
    wrong = F.when(F.col(value).isNull(), F.lit("NULL values"))
    if on_gap != "row":
        df = df.withColumn("_step", _step(keys, at, unit))
        wrong = wrong.when(F.col("_step") != 1, F.lit("periods missing or repeated"))
    complaint = F.raise_error(F.concat(F.lit("no autocorrelation of a series: "), wrong)).cast("boolean")
    df = df.where(F.when(wrong.isNotNull(), complaint).otherwise(True))
    whole = Window.partitionBy(*keys)
    y = F.col(value)
    centred = df.select(
        *keys,
        (F.row_number().over(whole.orderBy(at)) - 1).alias("i"),
        F.count("*").over(whole).alias("n"),
        F.when(F.min(y).over(whole) < F.max(y).over(whole), y - F.avg(y).over(whole)).otherwise(0.0).alias("z"),
    )
    block = F.floor(F.col("i") / max_lag)
    own = F.struct(block.alias("block"), F.lit(1).alias("head"))
    before = F.struct((block - 1).alias("block"), F.lit(0).alias("head"))
    blocks = (
        centred.select(*keys, "n", "i", "z", F.inline(F.when(block > 0, F.array(own, before)).otherwise(F.array(own))))
        .groupBy(*keys, "n", "block")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda p: p["z"]).alias("z"),
            F.sum("head").alias("n_head"),
        )
    )
    sums = (
        blocks.select(*keys, "n", F.posexplode(_lag_products(max_lag)("z", "n_head")).alias("lag", "part"))
        .groupBy(*keys, "n", "lag")
        .agg(F.sum("part").alias("c"))
    )
    scale = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(whole)
    root_n = F.sqrt(F.col("n").cast("double"))
    return (
        sums.select(
            *keys,
            "n",
            "lag",
            F.try_divide(F.col("c"), scale).alias("r"),
            # two-sided normal quantiles for 95 % and 99 %
            (F.lit(1.959963984540054) / root_n).alias("band_95"),
            (F.lit(2.5758293035489004) / root_n).alias("band_99"),
        )
        .where((F.col("lag") > 0) & (F.col("lag") < F.col("n")))
    )
