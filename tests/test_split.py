import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import split
from tidemark.plans import baseline, validation
from tidemark.registry.queries import _dense_panel

SCHEMA = "date date, store_id int, product_id int, qty decimal(12,2)"
DAY0 = dt.date(2020, 1, 1)


def frame(spark, day_numbers):
    rows = [(None if d is None else DAY0 + dt.timedelta(days=d), i, i, 1) for i, d in enumerate(day_numbers)]
    from decimal import Decimal

    return spark.createDataFrame([(d, s, p, Decimal(q)) for d, s, p, q in rows], SCHEMA)


def naive_train(panel, share=0.8):
    rank = F.percent_rank().over(Window.orderBy("date"))
    return {r.store_id for r in panel.withColumn("r", rank).where(F.col("r") <= share).collect()}


def ours_train(panel, share=0.8):
    return {r.store_id for r in split.flag_split(panel, share).where("is_train").collect()}


@pytest.mark.parametrize(
    "days",
    [
        [0],
        [0, 0, 0],
        [0, 1],
        list(range(10)),
        list(range(11)),
        [0, 1, 2, 3, 4, 4, 4, 4, 4, 5],  # a tie across the boundary
        [None, None, 0, 1, 2],
        [None, None],
        [5] * 9 + [6],
    ],
)
def test_split_equals_percent_rank(spark, days):
    panel = frame(spark, days)
    assert ours_train(panel) == naive_train(panel)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.sampled_from([0.5, 0.8, 0.9]))
def test_split_property(spark, days, share):
    panel = frame(spark, days)
    assert ours_train(panel, share) == naive_train(panel, share)


def test_split_covers_the_panel(spark, folder):
    panel = _dense_panel(spark, folder)
    train, test = split.chrono_split(panel)
    assert train.count() + test.count() == panel.count()
    last_train = train.agg(F.max("date")).first()[0]
    assert last_train < test.agg(F.min("date")).first()[0]
    assert last_train == split.split_cutoff(panel).first().cutoff


def test_undated_rows_train(spark):
    panel = frame(spark, [None, 0, 1, 2, 3, 4])
    train, test = split.chrono_split(panel)
    assert train.where("date IS NULL").count() == 1
    assert train.count() + test.count() == 6


def test_predict_equals_fit_join(spark, folder):
    """The window form against the fit table joined back."""
    flagged = split.flag_split(_dense_panel(spark, folder))
    fit = baseline.fit_panel(flagged.where("is_train")).select("month_start", "store_id", "product_id", "prediction")
    for key, back in (("year_month", 0), ("seasonal", 12)):
        joined = flagged.withColumn("month_start", F.trunc(F.add_months("date", -back), "MM")).join(
            fit, ["month_start", "store_id", "product_id"]
        )
        want = joined.select("date", "store_id", "product_id", F.round("prediction", 9))
        got = (
            baseline.predict(flagged, key)
            .where("matched")
            .select("date", "store_id", "product_id", F.round("prediction", 9))
        )
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_predict_ignores_rows_without_keys(spark):
    from decimal import Decimal

    rows = [(DAY0, None, 1, Decimal(1)), (DAY0, None, 1, Decimal(2)), (DAY0, 1, 1, Decimal(4))]
    flagged = spark.createDataFrame(rows, SCHEMA).withColumn("is_train", F.lit(True))
    got = baseline.predict(flagged).collect()
    assert sorted((r.matched, r.prediction) for r in got if r.store_id is None) == [(False, None)] * 2
    assert [r.prediction for r in got if r.store_id == 1] == [4.0]


def test_one_shuffle_fit_equals_panel_fit(spark):
    from decimal import Decimal

    day = [DAY0 + dt.timedelta(days=i) for i in range(40)]
    rows = [(day[0], 1, 1, Decimal(3)), (day[0], 1, 1, Decimal(5)), (day[1], 1, 1, None), (day[30], 1, 1, Decimal(1))]
    rows += [(day[35], 1, 1, Decimal(7)), (day[2], 2, 1, None), (day[2], 2, 2, Decimal(9))]
    sales = spark.createDataFrame(rows, SCHEMA)
    panel = sales.groupBy("date", "store_id", "product_id").agg(F.sum("qty").alias("qty"))
    keys = ["month_start", "store_id", "product_id", "prediction"]
    want = {tuple(r) for r in baseline.fit_panel(panel).select(*keys).collect()}
    assert {tuple(r) for r in baseline.fit_sales(sales).select(*keys).collect()} == want
    # January 2020: 9 units over 31 days; days without a sale count
    filled = baseline.fit_sales(sales, zero_fill=True).where("store_id = 1 AND month_start = DATE'2020-01-01'")
    assert filled.first().prediction == pytest.approx(9 / 31)


def test_folds_do_not_overlap(spark, folder):
    panel = _dense_panel(spark, folder)
    bounds = split.fold_bounds(panel, 4, 90, 30).orderBy("fold").collect()
    assert [b.fold for b in bounds] == [1, 2, 3, 4]
    for earlier, later in zip(bounds, bounds[1:]):
        assert later.test_start == earlier.test_end + dt.timedelta(days=1)
    for b in bounds:
        assert (b.test_end - b.test_start).days == 89
        assert (b.test_start - b.train_end).days == 31
    assigned = validation.assign_folds(panel, 4, 90).where("fold IS NOT NULL")
    spans = assigned.groupBy("fold").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()
    limits = {b.fold: b for b in bounds}
    assert all(limits[s.fold].test_start <= s.a and s.b <= limits[s.fold].test_end for s in spans)
