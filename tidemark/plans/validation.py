"""Rolling time-series cross-validation of the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.functions.numbers import exact_mean
from tidemark.operators.stats import rmse
from tidemark.plans.baseline import FIT_KEYS, LOOKBACK_MONTHS
from tidemark.plans.forecast import from_last_date


def assign_folds(panel: DataFrame, n_folds: int, test_days: int) -> DataFrame:
    """Each row's ``fold``: the one whose test window holds its date, NULL outside all. The windows of
    :func:`tidemark.operators.split.fold_bounds` are equally long and end on the last day, so this is arithmetic."""
    last = panel.agg(F.max("date").alias("last")).scalar()
    age = F.floor(F.datediff(last, "date") / test_days)
    return panel.withColumn("fold", F.when(age < n_folds, (n_folds - age).cast("int")))


def rolling_predictions(
    panel: DataFrame, n_folds: int, test_days: int, gap_days: int = 0, key: str = "seasonal"
) -> DataFrame:
    """The test rows of all folds with the baseline fitted on each fold's own past.

    A train window grows from fold to fold. Instead of a copy of the past for each fold, one fit table holds the
    mean of every (month, store, product) once per fold. Only the months the test windows look back to are fitted,
    and both sides are date filters on the panel, so on a staged panel neither reads the whole history.
    """
    at = from_last_date(panel)
    last, back = at(lambda last: last), LOOKBACK_MONTHS[key]
    reach = n_folds * test_days - 1
    first_test = at(lambda last: F.date_sub(last, reach))

    tests = assign_folds(panel.where(F.col("date") >= first_test), n_folds, test_days).withColumn(
        "month_start", month_start(F.col("date"))
    )
    donors = panel.where(
        (F.col("date") >= at(lambda last: month_start(F.add_months(F.date_sub(last, reach), -back))))
        & (F.col("date") <= at(lambda last: F.last_day(F.add_months(last, -back))))
    )

    def train_qty(fold):
        train_end = F.date_sub(last, (n_folds - fold + 1) * test_days + gap_days)
        return F.when(F.col("date") <= train_end, F.col("qty"))

    folds = range(1, n_folds + 1)
    fits = donors.groupBy(
        F.add_months(month_start(F.col("date")), back).alias("month_start"), "store_id", "product_id"
    ).agg(*[exact_mean(train_qty(k)).alias(f"_mean_{k}") for k in folds])
    own = F.coalesce(*[F.when(F.col("fold") == k, F.col(f"_mean_{k}")) for k in folds])
    return tests.join(fits, list(FIT_KEYS), "left").select(
        "fold", "date", "store_id", "product_id", "qty", own.alias("prediction")
    )


def rolling_scores(
    panel: DataFrame, n_folds: int = 4, test_days: int = 90, gap_days: int = 30, key: str = "seasonal"
) -> DataFrame:
    """RMSE and coverage per fold."""
    return rmse(rolling_predictions(panel, n_folds, test_days, gap_days, key), "qty", "prediction", ["fold"])
