import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from tidemark.operators import panel, series


def monthly(spark, values, key="a", start=(2010, 1), skip=()):
    y0, m0 = start
    rows = [
        (key, dt.date(y0 + (m0 - 1 + i) // 12, (m0 - 1 + i) % 12 + 1, 1), float(v))
        for i, v in enumerate(values)
        if i not in skip
    ]
    return spark.createDataFrame(rows, "series string, month_start date, qty double")


PATTERN = np.array([1.5, 0.8, 0.7, 0.9, 1.0, 1.1, 1.0, 0.9, 1.0, 1.05, 1.0, 1.05])


def exact(n=48):
    return [(100 + t) * PATTERN[t % 12] for t in range(n)]


def textbook(y, period, multiplicative=True):
    """Classical decomposition in numpy, from its definition."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    weights = np.ones(period + 1) / period if period % 2 == 0 else np.ones(period) / period
    if period % 2 == 0:
        weights[[0, -1]] /= 2
    half = len(weights) // 2
    trend = np.full(n, np.nan)
    for i in range(half, n - half):
        trend[i] = weights @ y[i - half : i + half + 1]
    away = y / trend if multiplicative else y - trend
    s = np.array([np.nanmean(away[k::period]) for k in range(period)])
    s = s / s.mean() if multiplicative else s - s.mean()
    seasonal = np.resize(s, n)
    return trend, seasonal, y / trend / seasonal if multiplicative else y - trend - seasonal


@pytest.mark.parametrize("period,model", [(12, "multiplicative"), (12, "additive"), (7, "additive"), (3, "multiplicative")])
def test_decompose_equals_textbook(spark, period, model):
    rng = np.random.default_rng(3)
    y = rng.uniform(50, 150, 40)
    got = series.decompose(monthly(spark, y), ["series"], period=period, model=model).orderBy("month_start").toPandas()
    for name, want in zip(("trend", "seasonal", "resid"), textbook(y, period, model == "multiplicative")):
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), want, rtol=1e-9, err_msg=name)


def test_decompose_properties(spark):
    out = series.decompose(monthly(spark, exact()), ["series"]).orderBy("month_start").toPandas()
    inner = out.dropna()
    assert len(inner) == 36
    np.testing.assert_allclose(inner.trend * inner.seasonal * inner.resid, inner.qty)
    assert abs(out.seasonal[:12].mean() - 1) < 1e-12
    assert out.seasonal[:12].idxmax() == 0


def test_many_series_are_independent(spark):
    one, two = exact(), [v * 3 for v in exact()]
    both = monthly(spark, one).union(monthly(spark, two, "b"))
    out = series.decompose(both, ["series"]).toPandas().sort_values(["series", "month_start"])
    a, b = (out[out.series == k].reset_index(drop=True) for k in "ab")
    np.testing.assert_allclose(a.seasonal, b.seasonal)
    np.testing.assert_allclose(a.trend * 3, b.trend)


def test_short_series_is_refused(spark):
    short = monthly(spark, exact(23))
    with pytest.raises(PySparkException, match="fewer than 24 rows"):
        series.decompose(short, ["series"]).collect()
    assert series.decompose(short, ["series"], on_refused="drop").count() == 0
    tiny = monthly(spark, exact(5))
    with pytest.raises(PySparkException, match="fewer than 24 rows"):
        series.decompose(tiny, ["series"]).collect()
    assert [r.issue for r in series.series_issues(short, ["series"]).collect()] == ["fewer than 24 rows"]


def test_gap_policy(spark):
    gap = monthly(spark, exact(36), skip={10})
    with pytest.raises(PySparkException, match="periods missing"):
        series.decompose(gap, ["series"]).collect()
    with pytest.raises(PySparkException, match="zero or negative"):
        series.decompose(gap, ["series"], on_gap="zero").collect()
    filled = series.decompose(gap, ["series"], model="additive", on_gap="zero")
    assert filled.count() == 36


def test_unknown_arguments(spark):
    with pytest.raises(ValueError):
        series.decompose(monthly(spark, exact()), model="other")


def daily(spark, values, key="a"):
    rows = [(key, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, date date, qty double")


@pytest.mark.parametrize("n,max_lag", [(100, 10), (100, 99), (100, 400), (31, 10), (7, 3), (20, 10), (1, 5)])
def test_autocorrelation_equals_definition(spark, n, max_lag):
    y = np.random.default_rng(n + max_lag).normal(10, 3, n)
    got = series.autocorrelation(daily(spark, y), ["series"], max_lag=max_lag).toPandas().sort_values("lag")
    z = y - y.mean()
    lags = range(1, min(max_lag, n - 1) + 1)
    assert list(got.lag) == list(lags)
    want = [float(z[:-h] @ z[h:] / (z @ z)) for h in lags]
    np.testing.assert_allclose(got.r.to_numpy(dtype=float), want, rtol=1e-9, atol=1e-12)
    assert (got.r.abs() <= 1 + 1e-12).all()
    if len(got):
        np.testing.assert_allclose(got.band_95.iloc[0], 1.959963984540054 / np.sqrt(n))


def test_constant_series_has_no_autocorrelation(spark):
    got = series.autocorrelation(daily(spark, [0.1] * 10), ["series"], max_lag=3).collect()
    assert [r.r for r in got] == [None] * 3


def test_fill_calendar(spark):
    gap = monthly(spark, exact(6), skip={2, 3})
    filled = series.fill_calendar(gap, ["series"], "month_start", "qty").orderBy("month_start").toPandas()
    assert len(filled) == 6 and list(filled.qty[2:4]) == [0, 0]
    assert pd.to_datetime(filled.month_start).dt.day.eq(1).all()


def test_fill_calendar_keeps_series_without_a_key(spark):
    rows = [(None, dt.date(2020, 1, d), float(d)) for d in (1, 3)] + [("b", dt.date(2020, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "series string, date date, qty double")
    filled = series.fill_calendar(df, ["series"], "date", "qty", unit="day", fill=None)
    got = {(r.series, r.date.day): r.qty for r in filled.collect()}
    assert got == {(None, 1): 1.0, (None, 2): None, (None, 3): 3.0, ("b", 1): 5.0}


def test_fill_calendar_over_a_year_end(spark):
    rows = [("a", dt.date(2019, 11, 1), 1.0), ("a", dt.date(2020, 3, 1), 4.0), ("a", dt.date(2020, 4, 1), 5.0)]
    df = spark.createDataFrame(rows, "series string, month_start date, qty double")
    filled = series.fill_calendar(df, ["series"], "month_start", "qty").orderBy("month_start").collect()
    assert [(r.month_start.month, r.qty) for r in filled] == [(11, 1), (12, 0), (1, 0), (2, 0), (3, 4), (4, 5)]


def test_a_missing_and_a_repeated_month_do_not_cancel(spark):
    whole = monthly(spark, exact(36), skip=(10,))
    doubled = whole.union(whole.where("month_start = DATE '2011-06-01'"))
    assert [r.issue for r in series.series_issues(doubled, ["series"]).collect()] == ["periods missing or repeated"]
    with pytest.raises(PySparkException, match="missing or repeated"):
        series.decompose(doubled, ["series"]).collect()


def test_refusal_does_not_depend_on_the_columns_asked_for(spark):
    with pytest.raises(PySparkException, match="fewer than 24 rows"):
        series.decompose(monthly(spark, exact(20)), ["series"]).select("series", "qty").collect()


def test_calendar_refuses_rows_without_a_date(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("a", None, 5.0)], "series string, month_start date, qty double")
    with pytest.raises(PySparkException, match="no month_start"):
        series.fill_calendar(rows, ["series"], "month_start", "qty").collect()


def unbroken(spark, values, skip=()):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "date date, qty double")


@pytest.mark.parametrize("values, skip", [([1.0, 2.0, 4.0] * 8, (5,)), ([1.0, None, 3.0] * 8, ())])
def test_autocorrelation_refuses_gaps_and_nulls(spark, values, skip):
    with pytest.raises(PySparkException, match="no autocorrelation"):
        series.autocorrelation(unbroken(spark, values, skip), max_lag=3).collect()


def test_autocorrelation_fills_gaps_or_counts_rows(spark):
    values = [float((7 * i) % 11) for i in range(40)]
    gapped = unbroken(spark, values, (5, 20))
    filled = unbroken(spark, [0.0 if i in (5, 20) else v for i, v in enumerate(values)])
    r = lambda df, how: [round(x.r, 12) for x in series.autocorrelation(df, max_lag=4, on_gap=how).orderBy("lag").collect()]
    assert r(gapped, "zero") == r(filled, "refuse")
    closed = unbroken(spark, [v for i, v in enumerate(values) if i not in (5, 20)])
    assert r(gapped, "row") == r(closed, "refuse")


def test_short_series_are_dealt_by_rows(spark, monkeypatch):
    """Totals by series and month and the windows after them share one shuffle, whose partitions follow the rows."""
    keys = ["store_id", "product_id"]
    sales = spark.range(3000).selectExpr("date_add(DATE'2020-01-01', int(id % 900)) AS date", "id % 7 AS store_id", "id % 50 AS product_id", "double(id % 4) AS qty")
    monkeypatch.setattr(panel, "SERIES_ROWS", 100)
    dealt = panel.by_series(sales, keys)
    assert dealt.rdd.getNumPartitions() == -(-sales.count() // 100) > 16
    got, want = panel.monthly_totals(dealt, keys), panel.monthly_totals(sales, keys)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    found = series.series_issues(got, keys)
    assert found.groupBy("issue").count().collect() == series.series_issues(want, keys).groupBy("issue").count().collect()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
