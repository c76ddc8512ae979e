import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.operators.features import FeatureSpec
from tidemark.operators.split import flag_split, fold_bounds
from tidemark.plans import least_squares, regressors
from tidemark.registry.queries import AS_OF_YEAR, _trio
from tidemark.runtime import stage


@pytest.fixture(scope="module")
def trio(spark, folder):
    return _trio(spark, folder, "sparse")


@pytest.fixture(scope="module")
def flagged(trio):
    return stage(flag_split(panel.daily_panel(trio[0])), "test-panel")


def errors(df):
    return {r.split: (r.n_rows, r.n_scored, r.rmse) for r in df.collect()}


def test_same_errors_as_on_vectors(trio, flagged):
    """All features, collinear ones among them: the fit is the same though coefficients may be dealt otherwise."""
    ours = errors(least_squares.linear_errors(flagged, *trio[1:], as_of_year=AS_OF_YEAR))
    exact = regressors.linear(solver="l-bfgs").setTol(1e-12).setMaxIter(1000)
    theirs = errors(regressors.regressor_errors(flagged, *trio[1:], [exact], as_of_year=AS_OF_YEAR))
    assert ours["train"][:2] == theirs["train"][:2] and ours["test"][:2] == theirs["test"][:2]
    assert ours["train"][2] == pytest.approx(theirs["train"][2], abs=1e-6)
    assert ours["test"][2] == pytest.approx(theirs["test"][2], abs=1e-4)


def dense(rows, spec):
    """The design matrix in numpy, one column per category value."""
    cats = [*spec.store_categories, *spec.product_categories]
    columns = [np.ones(len(rows))] + [rows[c].to_numpy(float) for c in spec.numeric]
    for c in cats:
        columns += [(rows[c] == v).to_numpy(float) for v in sorted(rows[c].unique())]
    return np.column_stack(columns)


def test_predictions_are_those_of_a_dense_fit(trio, flagged):
    spec = FeatureSpec(numeric=("month", "day_of_week"), store_categories=("region", "city"), product_categories=("category", "supplier"))
    model = least_squares.fit_linear(flagged, *trio[1:], spec, AS_OF_YEAR)
    rows = panel.enrich(flagged.where("is_train"), *trio[1:], AS_OF_YEAR)
    got = model.predict(rows).toPandas()
    x, y = dense(got, spec), got["qty"].to_numpy(float)
    np.testing.assert_allclose(got["linear"], x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


def test_dependent_columns_are_left_out():
    dice = np.random.default_rng(0)
    x = dice.normal(size=(200, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(200)])
    y = x @ np.arange(1.0, 7.0) + dice.normal(size=200)
    weights = least_squares.solve(x.T @ x, x.T @ y)
    np.testing.assert_allclose(x @ weights, x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-9)
    assert (weights == 0).sum() == 2


SMALL = FeatureSpec(numeric=("day_of_week",), store_categories=("region",), product_categories=("category",))


def small(spark, n=120):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(n)]
    rows = [(d, k % 3, k % 2, float((k * 13) % 17)) for k, d in enumerate(days)]
    stores = spark.createDataFrame([(0, "N", 2000), (1, "S", 2001), (2, None, 2002)], "store_id int, region string, opened_year int")
    products = spark.createDataFrame([(0, "p"), (1, "q")], "product_id int, category string")
    return spark.createDataFrame(rows, "date date, store_id int, product_id int, qty double"), stores, products


def test_null_targets_numbers_and_categories(spark):
    rows, stores, products = small(spark)
    flagged = rows.withColumns({"is_train": F.lit(True), "qty": F.when(F.dayofmonth("date") != 3, F.col("qty"))})
    model = least_squares.fit_linear(flagged, stores, products, SMALL, 2021)
    got = model.predict(panel.enrich(flagged, stores, products, 2021)).toPandas()
    known = got[got.qty.notna()]
    x = np.column_stack([np.ones(len(known)), known.day_of_week, known.region == "N", known.region == "S", known.category == "p"]).astype(float)
    want = x @ np.linalg.lstsq(x, known.qty.to_numpy(float), rcond=None)[0]
    np.testing.assert_allclose(known.linear, want, atol=1e-9)
    assert got.linear.notna().all()
    odd = spark.createDataFrame([("Z", None)], "region string, category string").selectExpr("2 AS store_id", "1 AS product_id", "3 AS day_of_week", "*")
    assert model.predict(odd).first().linear is not None


def test_nothing_to_learn_from(spark):
    rows, stores, products = small(spark)
    flagged = rows.withColumn("is_train", F.lit(False))
    got = errors(least_squares.linear_errors(flagged, stores, products, SMALL, 2021))
    assert set(got) == {"test"} and got["test"][:2] == (120, 120)


def test_too_many_columns(trio, flagged, monkeypatch):
    monkeypatch.setattr(least_squares, "WIDEST", 10)
    with pytest.raises(least_squares.TooWide):
        least_squares.fit_linear(flagged, *trio[1:], as_of_year=AS_OF_YEAR)
    got = regressors.compare_models(
        flagged.drop("is_train"), *trio[1:], spec=FeatureSpec(numeric=("month",), store_categories=(), product_categories=("category",), tree_bins=8), as_of_year=AS_OF_YEAR
    )
    assert {r.model for r in got.collect()} == {"baseline", "linear", "forest_indexed"}


def test_widest_category_solved_apart(trio, flagged, monkeypatch):
    """A design too wide for one solve: the widest category is eliminated slot by slot, the predictions are the same."""
    spec = FeatureSpec(numeric=("month", "day_of_week", "years_open"), store_categories=("region", "store_code"), product_categories=("category", "product_name"))
    rows = panel.enrich(flagged.where("is_train"), *trio[1:], AS_OF_YEAR)
    whole = least_squares.design(rows, *trio[1:], spec)
    widest = max(r["count"] for r in whole.slots.groupBy("feature").count().collect())
    monkeypatch.setattr(least_squares, "WIDEST", whole.width - widest)
    made = least_squares.design(rows, *trio[1:], spec)
    assert whole.apart == (0, 0) and made.apart[1] - made.apart[0] == widest and made.narrow == whole.width - widest
    got = least_squares.fit_linear(flagged, *trio[1:], spec, AS_OF_YEAR).predict(rows).toPandas()
    x, y = dense(got, spec), got["qty"].to_numpy(float)
    np.testing.assert_allclose(got["linear"], x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


APART = FeatureSpec(numeric=("day_of_week",), store_categories=("region",), product_categories=("category", "code"))


def test_apart_with_nulls_and_unseen_values(spark, monkeypatch):
    rows, stores, products = small(spark)
    names = [(k, "pq"[k % 2], None if k == 5 else f"c{k}") for k in range(7)]
    products = spark.createDataFrame(names, "product_id int, category string, code string")
    rows = rows.withColumn("product_id", F.dayofyear("date") % 6)  # product 6 is never sold
    flagged = rows.withColumn("is_train", F.lit(True))
    monkeypatch.setattr(least_squares, "WIDEST", 6)
    model = least_squares.fit_linear(flagged, stores, products, APART, 2021)
    got = model.predict(panel.enrich(flagged, stores, products, 2021)).toPandas()
    cats = [got.region == "N", got.region == "S", got.category == "p", *[got.code == f"c{k}" for k in range(5)]]
    x, y = np.column_stack([np.ones(len(got)), got.day_of_week, *cats]).astype(float), got.qty.to_numpy(float)
    np.testing.assert_allclose(got.linear, x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)
    nothing = least_squares.fit_linear(rows.withColumn("is_train", F.lit(False)), stores, products, APART, 2021)
    assert nothing.predict(panel.enrich(rows, stores, products, 2021)).agg(F.max(F.abs("linear"))).first()[0] == 0


def test_folds_with_a_category_apart(spark, monkeypatch):
    rows, stores, products = small(spark, 400)
    products = spark.createDataFrame([(k, "pq"[k % 2], f"c{k}") for k in range(7)], "product_id int, category string, code string")
    rows = rows.withColumn("product_id", (F.crc32(F.col("date").cast("string")) % 7).cast("int"))
    folds = {"n_folds": 2, "test_days": 50, "gap_days": 20}
    want = {r.fold: r for r in least_squares.rolling_linear_scores(rows, stores, products, APART, **folds, as_of_year=2021).collect()}
    monkeypatch.setattr(least_squares, "WIDEST", 6)
    got = {r.fold: r for r in least_squares.rolling_linear_scores(rows, stores, products, APART, **folds, as_of_year=2021).collect()}
    assert set(got) == set(want) and all(got[k].rmse == pytest.approx(want[k].rmse, rel=1e-9) and got[k].n_scored == 50 for k in want)


def test_folds_from_running_sums(spark):
    """Each fold's scores are those of a fit on its own past, made anew."""
    rows, stores, products = small(spark, 400)
    folds = {"n_folds": 3, "test_days": 50, "gap_days": 20}
    got = {r.fold: r for r in least_squares.rolling_linear_scores(rows, stores, products, SMALL, **folds, as_of_year=2021).collect()}
    for fold in fold_bounds(rows, **folds).collect():
        past = rows.withColumn("is_train", F.col("date") <= F.lit(fold.train_end))
        model = least_squares.fit_linear(past, stores, products, SMALL, 2021)
        test = panel.enrich(rows.where(F.col("date").between(F.lit(fold.test_start), F.lit(fold.test_end))), stores, products, 2021)
        want = model.predict(test).agg(F.sqrt(F.avg((F.col("qty") - F.col("linear")) ** 2))).first()[0]
        assert got[fold.fold].rmse == pytest.approx(want, rel=1e-9) and got[fold.fold].n_rows == 50


def test_a_fold_without_a_past(spark):
    rows, stores, products = small(spark, 100)
    got = {r.fold: r for r in least_squares.rolling_linear_scores(rows, stores, products, SMALL, 2, 50, 10, 2021).collect()}
    assert (got[1].n_scored, got[1].rmse) == (0, None) and got[2].n_scored == 50
