"""Forecasts from the seasonal-mean baseline: each future day takes last year's mean for its month.

Roll-ups never build the days x stores x products grid. The fit is summed to the wanted level first, joined once per
month of the horizon, and spread over days last.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.operators.panel import daily_panel
from tidemark.operators.split import split_cutoff
from tidemark.plans.baseline import fit_sales

HORIZON = 90
HORIZONS = (30, 60, 90)


def from_last_date(sales: DataFrame, known: dt.date | None = None) -> Callable[[Callable[[Column], Column]], Column]:
    """Bounds counted from the last date: a function from date arithmetic to its value.

    The last date is found first, by a pass over the date column alone unless it is ``known``. So bounds are literals,
    which reach the scan whether it holds dates or timestamps cast to dates; a subquery reaches only the former, and not
    if Spark merges it with another one over the same table.
    """
    last = F.lit(known or last_sale_date(sales)).cast("date")
    return lambda bound: bound(last)


def last_sale_date(sales: DataFrame) -> dt.date | None:
    """The last date; NULL (None) for an empty table."""
    return sales.agg(F.max("date")).first()[0]


def future_calendar(sales: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The ``horizon`` days after the last date, each with its number, year, month and donor month a year before."""
    days = sales.agg(F.max("date").alias("last")).select(
        F.posexplode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("pos", "date")
    )
    return days.select(
        "date",
        (F.col("pos") + 1).alias("day_no"),
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        month_start(F.add_months("date", -12)).alias("donor_month"),
    )


def donor_fit(
    sales: DataFrame,
    at: Callable[[Callable[[Column], Column]], Column],
    horizon: int = HORIZON,
    fit_on: str = "all",
    share: float = 0.8,
    zero_fill: bool = False,
) -> DataFrame:
    """Fit over the months the horizon looks back to, counted by ``at`` (:func:`from_last_date`); other months are
    filtered at the scan.

    ``fit_on="train"`` uses only sales up to the chronological cutoff, so later donor months have no fit.
    """
    first_donor = at(lambda last: month_start(F.add_months(F.date_add(last, 1), -12)))
    last_donor = at(lambda last: F.last_day(F.add_months(F.date_add(last, horizon), -12)))
    donors = sales.where((F.col("date") >= first_donor) & (F.col("date") <= last_donor))
    observed = (sales.agg(F.min("date")).scalar(), at(lambda last: last))
    if fit_on == "train":
        cutoff = split_cutoff(daily_panel(sales), share).select("cutoff").scalar()
        donors = donors.where(F.col("date") <= cutoff)
        observed = (observed[0], F.least(observed[1], cutoff))
    elif fit_on != "all":
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    return fit_sales(donors, zero_fill, observed if zero_fill else None).withColumnRenamed("month_start", "donor_month")


def _with_months(entities: DataFrame, last: Column, horizon: int) -> DataFrame:
    """Each entity once per month the horizon touches, with the first and last horizon day in that month."""
    start, stop = F.date_add(last, 1), F.date_add(last, horizon)
    # a month has at least 28 days, and the first and last month may be cut
    n_months = horizon // 28 + 2
    months = entities.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n_months - 1)))).withColumn(
        "_month", F.add_months(month_start(start), F.col("_m"))
    )
    return (
        months.withColumns(
            {
                "donor_month": F.add_months("_month", -12),
                "start": start,
                "first_day": F.greatest(F.col("_month"), start),
                "last_day": F.least(F.last_day("_month"), stop),
            }
        )
        .where("first_day <= last_day")
        .drop("_m", "_month")
    )


def _lookup(entities: DataFrame, fit: DataFrame, ids: Sequence[str], last: Column, horizon: int) -> DataFrame:
    """Left join of the fit per entity and month; entities without a fit are kept with a prediction of 0."""
    return (
        _with_months(entities.select(*ids).distinct(), last, horizon)
        .join(fit, [*ids, "donor_month"], "left")
        .withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))
    )


def _by_day(looked_up: DataFrame, ids: Sequence[str]) -> DataFrame:
    return looked_up.select(F.explode(F.sequence("first_day", "last_day")).alias("date"), *ids, "prediction")


def _rolled(
    sales: DataFrame, stores: DataFrame, products: DataFrame, level: str, at: Callable, horizon: int, options: dict
) -> DataFrame:
    """Per entity of ``level`` and month: the fit summed over the other dimension's known members."""
    fit = donor_fit(sales, at, horizon, **options)
    if level == "product_id":
        entities, others, other_id = products, stores, "store_id"
    elif level == "store_id":
        entities, others, other_id = stores, products, "product_id"
    else:
        raise ValueError(f"level must be 'store_id' or 'product_id', not {level!r}")
    summed = (
        fit.join(others.select(other_id), other_id, "left_semi")
        .groupBy(level, "donor_month")
        .agg(F.sum("prediction").alias("prediction"))
    )
    return _lookup(entities, summed, [level], at(lambda last: last), horizon)


def forecast_daily(
    sales: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    level: str = "product_id",
    horizon: int = HORIZON,
    last_date: dt.date | None = None,
    **options,
) -> DataFrame:
    """``(date, level, prediction)``: daily demand per product over all stores, or per store over all products."""
    at = from_last_date(sales, last_date)
    return _by_day(_rolled(sales, stores, products, level, at, horizon, options), [level])


def forecast_horizons(
    sales: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    level: str = "product_id",
    horizons: Sequence[int] = HORIZONS,
    last_date: dt.date | None = None,
    **options,
) -> DataFrame:
    """``demand_<h>`` per entity: total over the first h days, as month mean times days, without a row per day."""
    months = _rolled(sales, stores, products, level, from_last_date(sales, last_date), max(horizons), options)

    def days_within(h):
        stop = F.least(F.col("last_day"), F.date_add("start", h - 1))
        return F.greatest(F.datediff(stop, "first_day") + 1, F.lit(0))

    return months.groupBy(level).agg(
        *[F.sum(F.col("prediction") * days_within(h)).alias(f"demand_{h}") for h in horizons]
    )


BROADCAST_BYTES = 32 << 20  # of store ids; beyond that Spark chooses how the two lists meet


def forecast_grid(
    sales: DataFrame, stores: DataFrame, products: DataFrame, horizon: int = HORIZON, last_date: dt.date | None = None
) -> DataFrame:
    """Every (store, product) with the months of the horizon. The product of the two is the result asked for here;
    the roll-ups above do not use it. Products are dealt by ``product_id`` and meet the measured list of stores where
    they lie, so the grid keeps that partitioning."""
    ids = stores.select("store_id").distinct()
    held = F.octet_length(F.col("store_id").cast("string")) + 16  # a row's overhead
    if (ids.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    pairs = products.select("product_id").distinct().repartition("product_id").crossJoin(ids)
    return _with_months(pairs.select("store_id", "product_id"), from_last_date(sales, last_date)(lambda last: last), horizon)


def forecast_cells(
    sales: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    horizon: int = HORIZON,
    last_date: dt.date | None = None,
    **options,
) -> DataFrame:
    """``(date, store_id, product_id, prediction)`` for every cell of the grid, 0 where last year has no sale.

    Grid and fit are both dealt by ``product_id``. With ``spark.sql.requireAllClusterKeysForCoPartition`` set to false
    Spark joins them on all keys as they lie, and of the two only the product list and the fit are shuffled.
    """
    ids = ["store_id", "product_id"]
    last_date = last_date or last_sale_date(sales)  # once, for fit and grid
    fit = donor_fit(sales, from_last_date(sales, last_date), horizon, **options).repartition("product_id")
    grid = forecast_grid(sales, stores, products, horizon, last_date).join(fit, [*ids, "donor_month"], "left")
    return _by_day(grid.withColumn("prediction", F.coalesce("prediction", F.lit(0.0))), ids)


def grid_size(sales: DataFrame, stores: DataFrame, products: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Days, stores, products and cells of the grid, from the key counts."""
    n_stores = stores.agg(F.count_distinct("store_id")).scalar()
    n_products = products.agg(F.count_distinct("product_id")).scalar()
    return (
        future_calendar(sales, horizon)
        .agg(F.count("*").alias("n_days"))
        .select(
            "n_days",
            n_stores.alias("n_stores"),
            n_products.alias("n_products"),
            (F.col("n_days") * n_stores * n_products).alias("n_cells"),
        )
    )
