import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.plans import baseline, forecast
from tidemark.registry.queries import _trio
from tidemark.sources import sinks

SCHEMA = "date date, store_id int, product_id int, qty decimal(12,2)"


@pytest.fixture(scope="module")
def leap(spark):
    """Two stores, two products, ending on 2019-12-31, so that the 90 days hold 29 February 2020."""
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    rows = [(d, 1, 1, Decimal(d.month)) for d in days]
    rows += [(d, 2, 1, Decimal(10)) for d in days if d.month == 2 and d.day <= 10]
    rows += [(d, 9, 1, Decimal(1000)) for d in days]  # a store outside the dimension
    sales = spark.createDataFrame(rows, SCHEMA)
    stores = spark.createDataFrame([(1,), (2,)], "store_id int")
    products = spark.createDataFrame([(1,), (2,)], "product_id int")
    return sales, stores, products


def test_calendar_has_every_day(leap):
    days = [r.date for r in forecast.future_calendar(leap[0]).orderBy("date").collect()]
    assert len(days) == 90
    assert days[0] == dt.date(2020, 1, 1) and days[-1] == dt.date(2020, 3, 30)
    assert dt.date(2020, 2, 29) in days


def test_daily_values(leap):
    got = {(r.date, r.product_id): r.prediction for r in forecast.forecast_daily(*leap).collect()}
    assert len(got) == 180
    assert got[dt.date(2020, 1, 5), 1] == 1.0
    assert got[dt.date(2020, 2, 29), 1] == 2.0 + 10.0
    assert got[dt.date(2020, 3, 30), 1] == 3.0
    assert all(v == 0 for (d, p), v in got.items() if p == 2)


def test_horizons(leap):
    got = {r.product_id: r for r in forecast.forecast_horizons(*leap).collect()}
    assert got[1].demand_30 == 30.0
    assert got[1].demand_60 == 31 + 29 * 12
    assert got[1].demand_90 == 31 + 29 * 12 + 30 * 3
    assert got[2].demand_90 == 0


@pytest.mark.parametrize("level", ["product_id", "store_id"])
@pytest.mark.parametrize("options", [{}, {"fit_on": "train"}, {"zero_fill": True}])
def test_rollups_equal_the_full_grid(spark, folder, level, options):
    trio = _trio(spark, folder)
    cells = forecast.forecast_cells(*trio, **options)
    want = cells.groupBy("date", level).agg(F.round(F.sum("prediction"), 6).alias("prediction"))
    got = forecast.forecast_daily(*trio, level=level, **options).withColumn("prediction", F.round("prediction", 6))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    first = F.lit(forecast.last_sale_date(trio[0]))
    by_horizon = forecast.forecast_horizons(*trio, level=level, **options)
    for h in (30, 60, 90):
        want = {
            r[level]: r.s
            for r in cells.where(F.datediff("date", first) <= h).groupBy(level).agg(F.sum("prediction").alias("s")).collect()
        }
        assert {r[level]: pytest.approx(r[f"demand_{h}"], abs=1e-6) for r in by_horizon.collect()} == want


@pytest.mark.parametrize("horizon", [1, 27, 31, 90, 400])
def test_any_horizon(leap, horizon):
    rows = forecast.forecast_daily(*leap, horizon=horizon)
    assert rows.count() == 2 * horizon
    assert rows.select("date").distinct().count() == horizon


def test_grid_size(spark, leap):
    size = forecast.grid_size(*leap).first()
    assert (size.n_days, size.n_stores, size.n_products, size.n_cells) == (90, 2, 2, 360)
    assert forecast.forecast_cells(*leap).count() == 360


def test_bad_arguments(leap):
    with pytest.raises(ValueError):
        forecast.forecast_daily(*leap, level="other")
    with pytest.raises(ValueError):
        forecast.forecast_daily(*leap, fit_on="other")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_forecast(spark, leap, tmp_path, fmt):
    path = str(tmp_path / fmt)
    rows = forecast.forecast_daily(*leap)
    sinks.write_forecast(rows, path, fmt)
    if fmt == "csv":
        back = sinks.read_forecast_csv(spark, path, "date date, product_id int, prediction double")
        header = spark.read.text(path).where("value LIKE 'date,%'")
        assert header.count() >= 1
        dates = [r.date for r in back.collect()]
        assert dates == sorted(dates, reverse=True)
    else:
        back = spark.read.parquet(path)
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()


def test_zero_fill_counts_observed_days_only(spark):
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    sales = spark.createDataFrame([(d, 1, 1, 1.0) for d in days], "date date, store_id int, product_id int, qty double")
    at = forecast.from_last_date(sales)
    fit = forecast.donor_fit(sales, at, 365, fit_on="train", zero_fill=True).collect()
    assert fit and all(abs(r.prediction - 1) < 1e-12 for r in fit)


def test_fit_table_applied_to_other_rows(spark):
    sales = spark.createDataFrame(
        [(dt.date(2020, 3, 1), 1, 1, 2.0), (dt.date(2020, 3, 9), 1, 1, 4.0)], "date date, store_id int, product_id int, qty double"
    )
    rows = spark.createDataFrame([(dt.date(2021, 3, 5), 1, 1), (dt.date(2021, 4, 5), 1, 1)], "date date, store_id int, product_id int")
    fit = baseline.fit_panel(sales)
    left = baseline.apply_fit(rows, fit, "seasonal").orderBy("date").collect()
    assert [r.prediction for r in left] == [3.0, None]
    assert baseline.apply_fit(rows, fit, "seasonal", "inner").count() == 1
    assert baseline.apply_fit(rows, fit).where("prediction IS NOT NULL").count() == 0
