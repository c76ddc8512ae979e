import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators import lags, panel
from tidemark.operators.features import FeatureSpec
from tidemark.operators.split import flag_split
from tidemark.plans import regressors
from tidemark.registry.queries import _trio
from tidemark.runtime import stage


@pytest.fixture(scope="module")
def trio(spark, folder):
    return _trio(spark, folder, "sparse")


@pytest.fixture(scope="module")
def flagged(trio):
    return stage(flag_split(panel.daily_panel(trio[0])), "test-panel")


def error(rows, prediction, split):
    got = regressors.model_errors(rows, [prediction]).where(F.col("split") == split).first()
    assert got.n_rows == got.n_scored
    return got.rmse


def test_linear_beats_the_mean_on_train(trio, flagged, tmp_path):
    trained = regressors.train(flagged, *trio[1:], [regressors.linear()], as_of_year=2002)
    scored = trained.scorer.transform(trained.table)
    assert scored.count() == flagged.count()
    spread = trained.table.where("is_train").agg(F.stddev_pop("qty")).first()[0]
    assert error(scored, "linear", "train") <= spread
    path = str(tmp_path / "model")
    trained.scorer.write().save(path)
    again = PipelineModel.load(path).transform(trained.table)
    assert error(again, "linear", "test") == pytest.approx(error(scored, "linear", "test"))


def test_saved_pipeline_scores_rows_never_seen(spark, trio, flagged, tmp_path):
    _, stores, products = trio
    models = [regressors.linear(), regressors.indexed_forest(numTrees=3)]
    trained = regressors.train(flagged, stores, products, models, as_of_year=2002)
    path = str(tmp_path / "whole")
    trained.pipeline.write().save(path)
    key = flagged.select("store_id", "product_id").first()
    new = spark.createDataFrame([(dt.date(2031, 5, 4), *key)], "date date, store_id long, product_id long")
    got = PipelineModel.load(path).transform(panel.enrich(new, stores, products, 2002)).first()
    assert np.isfinite([got.linear, got.forest_indexed]).all()
    known = panel.enrich(flagged.where("NOT is_train"), stores, products, 2002)
    both = trained.pipeline.transform(known).select("date", "store_id", "product_id", F.col("linear").alias("again"))
    seen = trained.scorer.transform(trained.table).join(both, ["date", "store_id", "product_id"])
    assert seen.count() and seen.where("abs(linear - again) > 1e-6").count() == 0


@pytest.mark.parametrize("make", [regressors.forest, regressors.indexed_forest])
def test_forest_does_not_depend_on_partitions(trio, flagged, make):
    runs = []
    for n in (2, 5):
        trained = regressors.train(flagged, *trio[1:], [make(numTrees=3, maxDepth=3)], as_of_year=2002, partitions=n)
        name = make().getPredictionCol()
        runs.append(error(trained.scorer.transform(trained.table), name, "test"))
    assert runs[0] == pytest.approx(runs[1], rel=1e-9)


def test_indexed_forest_splits_by_category(trio, flagged):
    trained = regressors.train(flagged, *trio[1:], [regressors.indexed_forest(numTrees=3)], as_of_year=2002)
    assert " in {" in trained.scorer.stages[-1].toDebugString


def test_hashed_categories(trio, flagged):
    spec = FeatureSpec(hashed=("product_name", "store_code"), hash_width=64)
    trained = regressors.train(flagged, *trio[1:], [regressors.linear()], spec)
    assert error(trained.scorer.transform(trained.table), "linear", "train") > 0


def test_comparison_has_every_model_and_split(trio):
    got = regressors.compare_models(
        panel.daily_panel(trio[0]),
        *trio[1:],
        models=[regressors.linear(), regressors.forest(numTrees=2, maxDepth=2)],
        as_of_year=2002,
        scale_on="all",
    ).collect()
    assert {(r.model, r.split) for r in got} == {
        (m, s) for m in ("baseline", "linear", "forest") for s in ("train", "test")
    }
    assert len({r.n_rows for r in got if r.split == "train"}) == 1


def test_horizon_table_looks_only_ahead(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(50)]
    sales = spark.createDataFrame(
        [(d, 1, 1, float(i)) for i, d in enumerate(days)], "date date, store_id int, product_id int, qty double"
    ).withColumn("qty", F.col("qty").cast("decimal(12,2)"))
    table, _ = regressors.origin_table(sales, ["store_id"], [5])
    rows = {r.date: r for r in table.collect()}
    ten = rows[days[10]]
    assert ten.qty_next_5 == 11 + 12 + 13 + 14 + 15 and ten.ready_5
    assert ten.qty_lag_7 == 3 and ten.qty_mean_7 == pytest.approx(7.0)
    assert not rows[days[45]].ready_5 and rows[days[44]].ready_5


def test_horizon_forecast_keeps_short_series(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    rows = [(d, 1, 1, 5.0 + i % 7) for i, d in enumerate(days)] + [(d, 2, 1, 1.0) for d in days[-3:]]
    sales = spark.createDataFrame(rows, "date date, store_id int, product_id int, qty double").withColumn(
        "qty", F.col("qty").cast("decimal(12,2)")
    )
    got = {r.store_id: r for r in regressors.horizon_forecast(sales, horizons=[7, 14]).collect()}
    assert got[1].demand_7 == pytest.approx(sum(5 + k for k in range(7)), rel=0.05)
    assert got[2].demand_7 is None


def ar_series(spark, n=120):
    rng = np.random.default_rng(2)
    rows = []
    for key in ("a", "b"):
        y = list(rng.normal(20, 2, 3))
        for _ in range(n):
            y.append(4 + 0.5 * y[-1] + 0.2 * y[-2] + 0.1 * y[-3] + rng.normal(0, 1))
        rows += [(key, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    return rows


@pytest.mark.parametrize("difference", [False, True])
def test_autoregression_equals_plain_recursion(spark, difference):
    rows = ar_series(spark)
    df = spark.createDataFrame(rows, "k string, date date, qty double")
    got = regressors.autoregressive_forecast(df, ["k"], order=3, steps=10, difference=difference).toPandas()
    levels = {k: np.array([v for kk, _, v in rows if kk == k]) for k in "ab"}
    moves = {k: np.diff(v) if difference else v for k, v in levels.items()}
    xs, ys = [], []
    for v in moves.values():
        for i in range(3, len(v)):
            xs.append([1, v[i - 1], v[i - 2], v[i - 3]])
            ys.append(v[i])
    beta = np.linalg.lstsq(np.array(xs), np.array(ys), rcond=None)[0]
    for k, v in moves.items():
        path = list(v)
        for _ in range(10):
            path.append(beta[0] + beta[1:] @ np.array(path[-1:-4:-1]))
        want = np.array(path[-10:])
        if difference:
            want = levels[k][-1] + want.cumsum()
        mine = got[got.k == k].sort_values("step")
        np.testing.assert_allclose(mine.prediction, want, rtol=1e-6)
        assert list(mine.step) == list(range(1, 11))
        assert mine.date.iloc[0] == rows[len(rows) // 2 - 1][1] + dt.timedelta(days=1)


def test_spans_of_days_equal_direct_sums(spark):
    rng = np.random.default_rng(11)
    rows = []
    for key in (None, "a", "b"):
        for i in sorted(rng.choice(120, 60, replace=False)):
            rows.append((key, dt.date(2020, 1, 1) + dt.timedelta(days=int(i)), round(float(rng.uniform(0, 9)), 2)))
    df = spark.createDataFrame(rows, "k string, date date, qty double")
    for kind in ("double", "decimal(12,2)"):
        typed = df.withColumn("qty", F.col("qty").cast(kind))
        got = lags.demand_ahead(lags.trailing_means(typed, ["k"], [7, 28]), ["k"], [5, 30]).collect()
        assert len(got) == len(rows)
        for r in got:
            def total(first, last):
                return sum(q for k, d, q in rows if k == r.k and first <= (d - r.date).days <= last)

            assert r.qty_mean_7 == pytest.approx(total(-6, 0) / 7, abs=1e-9)
            assert r.qty_mean_28 == pytest.approx(total(-27, 0) / 28, abs=1e-9)
            assert r.qty_next_5 == pytest.approx(total(1, 5), abs=1e-9)
            assert r.qty_next_30 == pytest.approx(total(1, 30), abs=1e-9)


def test_lag_by_day_sees_gaps(spark):
    rows = [(1, dt.date(2020, 1, d), float(d)) for d in (1, 2, 4)]
    df = spark.createDataFrame(rows, "k int, date date, qty double")
    by_day = {r.date.day: r.qty_lag_1 for r in lags.lag_features(df, ["k"], [1], by="day").collect()}
    assert by_day == {1: None, 2: 1.0, 4: None}
    by_row = {r.date.day: r.qty_lag_1 for r in lags.lag_features(df, ["k"], [1]).collect()}
    assert by_row == {1: None, 2: 1.0, 4: 2.0}
    diff = {r.date.day: r.qty_diff for r in lags.first_difference(df, ["k"]).collect()}
    assert diff == {1: None, 2: 1.0, 4: 2.0}


def test_comparison_drops_its_tables(spark, trio, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(regressors, "stage", lambda df, label, sort=(): kept.append(stage(df, label, sort)) or kept[-1])
    regressors.compare_models(panel.daily_panel(trio[0]), *trio[1:], models=[regressors.linear()], as_of_year=2002)
    assert [t.staged_path is not None for t in kept] == [False, False, False, True]  # only the errors stay
    kept.clear()
    regressors.horizon_errors(trio[0].where("store_id < 3"), horizons=[5])
    assert [t.staged_path is not None for t in kept] == [False, True]


def test_trees_never_take_more_bins_than_the_spec_allows(trio, flagged):
    """Store codes and names have more values than slots; they come as bins, and unseen ones in the middle."""
    spec = FeatureSpec(tree_width=8, tree_bins=16)
    trained = regressors.train(flagged, *trio[1:], [regressors.indexed_forest(numTrees=3)], spec, as_of_year=2002)
    model = trained.scorer.stages[-1]
    assert model.getMaxBins() == 32
    names = trained.pipeline.stages[-2].getInputCols()
    assert "store_code_bin" in names and "region_index" in names
    new = panel.enrich(flagged.limit(5), *trio[1:], 2002).withColumn("store_code", F.lit("never seen"))
    with pytest.raises(Exception):  # the index of the linear model's encoder still refuses it
        trained.pipeline.transform(new).collect()
    kept = FeatureSpec(tree_width=8, tree_bins=16, invalid="keep")
    trained = regressors.train(flagged, *trio[1:], [regressors.indexed_forest(numTrees=3)], kept, as_of_year=2002)
    assert trained.pipeline.transform(new).where("forest_indexed IS NOT NULL").count() == 5


def test_wide_categories_stay_within_256_bins(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k % 90), k, k % 2, float(k % 7)) for k in range(600)]
    flagged = stage(flag_split(spark.createDataFrame(rows, "date date, store_id int, product_id int, qty double")), "wide")
    stores = spark.range(600).selectExpr("cast(id AS int) AS store_id", "concat('s', id) AS store_code", "concat('r', id % 3) AS region", "2000 AS opened_year")
    products = spark.range(2).selectExpr("cast(id AS int) AS product_id", "concat('p', id) AS category")
    spec = FeatureSpec(store_categories=("store_code", "region"), product_categories=("category",), tree_width=256, tree_bins=256)
    trained = regressors.train(flagged, stores, products, [regressors.indexed_forest(numTrees=2)], spec, as_of_year=2021)
    assert trained.scorer.stages[-1].getMaxBins() == 256


def per_series(y, order):
    rows = [[1.0, *y[i - order : i][::-1]] for i in range(order, len(y))]
    return np.linalg.lstsq(np.array(rows), np.array(y[order:]), rcond=None)[0]


@pytest.mark.parametrize("order", [1, 7])
def test_each_series_has_its_own_autoregression(spark, days, order):
    dice = np.random.default_rng(order)
    made = {}
    for k in range(5):
        y = [100.0 + k, 90.0, 95.0, 99.0, 93.0, 91.0, 97.0]
        for _ in range(150):
            y.append(10.0 * k + (0.2 + 0.1 * k) * y[-1] + 0.1 * y[-5] + float(dice.normal()))
        made[k] = y
    made[5], made[6] = [4.0] * 40, [1.0, 2.0]
    rows = [(k, d, v) for k, y in made.items() for d, v in zip(days("2020-01-01", len(y)), y)]
    df = spark.createDataFrame(rows, "k int, date date, qty double").repartition(4)
    got = regressors.autoregressive_forecast_by_series(df, ["k"], order, 12).toPandas()
    assert len(got) == 12 * len(made) and set(got.columns) == {"k", "step", "date", "prediction"}
    for k in range(5):
        path, w = list(made[k]), per_series(made[k], order)
        for _ in range(12):
            path.append(w[0] + sum(c * v for c, v in zip(w[1:], path[::-1])))
        part = got[got.k == k].sort_values("step")
        np.testing.assert_allclose(part.prediction, path[-12:], rtol=1e-7)
        assert part.date.iloc[0] == days("2020-01-01", len(made[k]) + 1)[-1]
    np.testing.assert_allclose(got[got.k == 5].prediction, 4.0)
    assert got[got.k == 6].prediction.isna().all() == (order > 1)


def test_sums_of_dense_and_sparse_vectors(spark):
    rows = [Vectors.sparse(5, [1, 4], [2.0, -1.0]), Vectors.dense([1.0, 0.5, 0.0, 0.0, 3.0]), Vectors.sparse(5, [], []), None]
    table = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], StructType([StructField("k", IntegerType()), StructField("v", VectorUDT())]))
    got = {r.slot: r.total for r in regressors.vector_sums(table, "v").collect()}
    assert got == {0: 1.0, 1: 2.5, 2: 0.0, 3: 0.0, 4: 2.0}


def test_fits_read_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    """Small files of vectors are not packed into one task of a fit."""
    seen = []

    class Probe(RandomForestRegressor):
        def fit(self, dataset, params=None):
            seen.append(max(dataset.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()))
            return super().fit(dataset, params)

    monkeypatch.setattr(regressors, "ROWS_PER_FILE", 50)
    stores = spark.createDataFrame([(k, f"r{k}", 2000) for k in range(3)], "store_id int, region string, opened_year int")
    products = spark.createDataFrame([(0, "p"), (1, "q")], "product_id int, category string")
    rows = spark.range(900).selectExpr("date_add(DATE'2020-01-01', int(id)) AS date", "int(id % 3) AS store_id", "int(id % 2) AS product_id", "double(id % 7) AS qty")
    flagged = stage(rows.withColumn("is_train", F.lit(True)), "probe")
    spec = FeatureSpec(numeric=("month",), store_categories=("region",), product_categories=("category",))
    model = Probe(featuresCol="tree_features", labelCol="qty", predictionCol="probe", numTrees=1, maxDepth=1)
    regressors.train(flagged, stores, products, [model], spec, 2021, partitions=2)
    assert seen and seen[0] <= 50
