"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest

from tidemark.operators import panel, series, split
from tidemark.plans import baseline, forecast, validation
from tidemark.registry import queries
from tidemark.registry.queries import QUERIES, _trio
from tidemark.runtime import stage


def executed(df) -> str:
    df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def final(text: str) -> str:
    """The plan trees as run, without the plans adaptive execution started from."""
    return "\n".join(part.split("== Initial Plan ==")[0] for part in text.split("== Final Plan =="))


def test_panel_is_shuffled_once_for_split_and_scoring(spark, folder):
    text = executed(baseline.scores(baseline.predictions(queries._dense_panel(spark, folder))))
    assert "ReusedExchange" in final(text)


def test_split_window_sees_days_not_rows(spark, folder):
    rows = queries._dense_panel(spark, folder)
    text = final(executed(split.flag_split(rows)))
    into_window = re.search(r"Window \(\d+\)\n(?:.*\n)*?.*rowCount=([\d.E+]+)", text)
    n_days = rows.select("date").distinct().count()
    # plan statistics are printed with three digits
    assert float(into_window.group(1)) == pytest.approx(n_days, rel=0.01)
    assert n_days < rows.count() / 2


@pytest.mark.parametrize("name", ["forecast_daily_by_product", "forecast_daily_by_store", "forecast_horizons_by_product"])
def test_rollups_have_no_product_of_tables(spark, folder, name):
    text = executed(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fit_from_sales_has_one_shuffle(spark, folder):
    sales = queries.standin.sales(spark, folder, "sparse")
    text = final(executed(baseline.fit_sales(sales)))
    assert len(re.findall(r"\+- Exchange \(", text)) == 1


def test_decomposition_has_one_shuffle_after_totals(spark, folder):
    sales = queries.standin.sales(spark, folder, "sparse")
    months = panel.monthly_totals(sales, ["store_id"])
    text = final(executed(series.decompose(months, ["store_id"], on_refused="drop")))
    assert len(re.findall(r"\+- Exchange \(", text)) == 2


def test_no_python_outside_autocorrelation(spark, folder):
    for name in ("clean_decimal_comma", "decompose_by_store", "baseline_rmse", "rolling_scores", "correlation_matrix"):
        text = executed(QUERIES[name](spark, folder))
        assert "Python" not in text, name


def test_only_fit_columns_are_read(spark, folder):
    trio = _trio(spark, folder, "sparse")
    text = executed(forecast.forecast_daily(*trio))
    schemas = re.findall(r"ReadSchema: struct<(l_[^>]*)>", text)
    assert schemas and all("l_extendedprice" not in s and "l_tax" not in s for s in schemas)


def pushed(text: str) -> list[str]:
    return [f for f in re.findall(r"PushedFilters: \[(.*?)\]\n", text) if "OrEqual" in f]


def test_donor_months_are_filtered_at_the_scan(spark, folder):
    sales, stores, products = _trio(spark, folder)
    staged = stage(sales, "pushed")
    for df in (
        forecast.forecast_daily(staged, stores, products),
        validation.rolling_predictions(staged_panel(spark, folder), 4, 90, 30),
    ):
        filters = pushed(executed(df))
        assert any("GreaterThanOrEqual(date" in f and "LessThanOrEqual(date" in f for f in filters), filters
    filters = pushed(executed(QUERIES["forecast_daily_by_product"](spark, folder)))
    assert any("GreaterThanOrEqual(l_shipdate" in f and "LessThan" in f for f in filters), filters


def staged_panel(spark, folder):
    return panel.staged_panel(queries.standin.sales(spark, folder))


@pytest.mark.parametrize("name", ["enriched_panel", "monthly_sales_by_store", "calendar_join", "onehot_store"])
def test_lookup_joins_gather_nothing(spark, folder, name):
    assert "GlobalLimit" not in executed(QUERIES[name](spark, folder))


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_grid_is_not_shuffled(spark, folder, threshold):
    keys = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": threshold}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = forecast.forecast_cells(*_trio(spark, folder))
        tree = executed(df).split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    above = tree.split("BroadcastNestedLoopJoin")[0].splitlines()
    depth = len(above[-1]) - len(above[-1].lstrip(" :+-"))
    path = [line for line in above if len(line) - len(line.lstrip(" :+-")) < depth]
    assert "BroadcastNestedLoopJoin" in tree and not any("Exchange" in line for line in path)
