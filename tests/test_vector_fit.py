import datetime as dt

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import functions as F

from tidemark.operators.features import FeatureSpec
from tidemark.plans import regressors, vector_fit
from tidemark.runtime import stage

WIDTH = 60


def vectors(spark, n=600, seed=3):
    """Dense and sparse rows of two numbers (one far from 0), a constant, and two categories, one of them wide."""
    dice, rows = np.random.default_rng(seed), []
    for k in range(n):
        wide, few = int(dice.integers(0, 50)), int(dice.integers(0, 4))
        cells = {0: 2000.0 + k % 9, 1: float(dice.normal()), 2: 3.0, 3 + wide: 1.0} | ({53 + few: 1.0} if few < 3 else {})
        v = Vectors.sparse(WIDTH, cells)
        y = 0.5 * cells[0] + 2 * cells[1] + wide % 7 + 3 * few + float(dice.normal())
        rows.append((wide, Vectors.dense(v.toArray()) if k % 5 == 0 else v, y))
    return spark.createDataFrame(rows, ["wide", "features", "y"])


def both(rows, **settings):
    models = [kind(labelCol="y", **settings).setSolver("l-bfgs").fit(rows) for kind in (LinearRegression, vector_fit.VectorRegression)]
    assert isinstance(models[1], LinearRegressionModel)
    return [(m.coefficients.toArray(), m.intercept) for m in models]


@pytest.mark.parametrize("held, slots, block", [(1 << 23, 1024, 100), (0, 1024, 1 << 17), (1 << 23, 8, 64)])
@pytest.mark.parametrize("iterations", [1, 25])
def test_same_coefficients_as_spark(spark, monkeypatch, held, slots, block, iterations):
    """On the driver and by tasks, from products and from the vectors themselves."""
    monkeypatch.setattr(vector_fit, "HELD", held)
    rows = stage(vectors(spark).repartition(3, "wide").sortWithinPartitions("wide"), "vectors")
    if held:  # on the driver; the sizes of blocks are those of this process
        monkeypatch.setattr(vector_fit, "BLOCK_SLOTS", slots)
        monkeypatch.setattr(vector_fit, "BLOCK_ROWS", block)
        made = rows.select(F.unwrap_udt("features").alias("v"), "y")
        cells = F.when(F.col("v.type") == 0, F.col("v.indices")).otherwise(F.sequence(F.lit(0), F.size("v.values") - 1))
        batches = made.select(cells.alias("i"), F.col("v.values").alias("x"), "y").toArrow().combine_chunks().to_batches()
        blocks = [b for b in vector_fit._blocks(iter(batches))]
        assert {b.column("products")[0].as_py() for b in blocks} <= {True, False} and sum(b.column("n")[0].as_py() for b in blocks) == 600
        assert (slots == 1024) == all(b.column("products")[0].as_py() for b in blocks)
        frame = stage(spark.createDataFrame([r for b in blocks for r in b.to_pylist()], vector_fit.BLOCK), "blocks")
        got = vector_fit._fitted(frame, WIDTH, iterations, 1e-6)
        want = both(rows, maxIter=iterations)[0]
    else:
        want, got = both(rows, maxIter=iterations)
    np.testing.assert_allclose(got[0], want[0], rtol=1e-5, atol=1e-7)
    assert got[1] == pytest.approx(want[1], rel=1e-6)


def test_odd_targets(spark):
    rows = vectors(spark, 40)
    same = vector_fit.VectorRegression(labelCol="y").setSolver("l-bfgs").fit(rows.withColumn("y", F.lit(4.0)))
    assert same.intercept == 4.0 and not same.coefficients.toArray().any()
    with pytest.raises(Exception, match="Labels MUST NOT be Null"):
        vector_fit.VectorRegression(labelCol="y").setSolver("l-bfgs").fit(rows.withColumn("y", F.when(F.col("wide") > 9, F.col("y"))))
    penalty = [k(labelCol="y", regParam=0.1).fit(rows).intercept for k in (LinearRegression, vector_fit.VectorRegression)]
    assert penalty[0] == pytest.approx(penalty[1])


SPEC = FeatureSpec(numeric=("month", "day_of_week"), store_categories=("store_code", "region"), product_categories=("category",))


def tables(spark, sold="id % 40"):
    stores = spark.range(41).selectExpr("int(id) AS store_id", "concat('s', id) AS store_code", "if(id = 40, NULL, concat('r', id % 3)) AS region", "2000 AS opened_year")
    products = spark.range(3).selectExpr("int(id) AS product_id", "concat('p', id) AS category")
    rows = spark.range(4000).selectExpr("date_add(DATE'2020-01-01', int(id / 40)) AS date", f"int({sold}) AS store_id", "int(id % 3) AS product_id", "double((id * 13) % 17) AS qty")
    return stage(rows.withColumn("is_train", F.lit(True)), "sold"), stores, products


def test_an_iteration_reads_fewer_numbers_than_the_vectors_have(spark):
    """Rows of a store lie together, blocks hold products, and files do not name every slot of their vectors."""
    flagged, stores, products = tables(spark)
    trained = regressors.train(flagged, stores, products, [regressors.linear()], SPEC, 2021, partitions=4)
    assert trained.table.schema["features_raw"].metadata == {"ml_attr": {"num_attrs": 2 + 40 + 2 + 2}}
    at = trained.table.select("store_id", F.input_file_name().alias("file")).distinct()
    assert at.groupBy("store_id").count().agg(F.max("count")).first()[0] == 1
    scaled = trained.scorer.stages[0].transform(trained.table)
    numbers = scaled.agg(F.sum(F.size(F.unwrap_udt("features")["values"]))).first()[0]
    blocks = vector_fit.block_rows(scaled, "features", "qty")
    assert blocks.agg(F.sum("n")).first()[0] == 4000 and blocks.where("NOT products").isEmpty()
    assert blocks.agg(F.sum(F.size("v"))).first()[0] < numbers / 10


def test_vectors_are_those_of_the_pipeline(spark):
    flagged, stores, products = tables(spark)
    trained = regressors.train(flagged, stores, products, [regressors.linear()], SPEC, 2021)
    known = regressors.enrich(flagged, stores, products, 2021)
    again = trained.pipeline.transform(known).select("date", "store_id", "product_id", F.col("features_raw").alias("again"), "linear")
    rows = trained.table.join(again, ["date", "store_id", "product_id"]).collect()
    assert len(rows) == 4000
    assert all(r.features_raw.size == r.again.size and (r.features_raw.toArray() == r.again.toArray()).all() for r in rows)
    seen = {(r.date, r.store_id): r.linear for r in trained.scorer.transform(trained.table).collect()}
    assert all(abs(seen[r.date, r.store_id] - r.linear) < 1e-9 for r in rows)
    assert min(r.date for r in rows) == dt.date(2020, 1, 1)


def test_null_category_is_an_error_only_where_sold(spark):
    flagged, stores, products = tables(spark, "id % 41")
    with pytest.raises(Exception, match="no slot for region"):
        regressors.train(flagged, stores, products, [regressors.linear()], SPEC, 2021)
    kept = regressors.train(flagged, stores, products, [regressors.linear()], FeatureSpec(SPEC.numeric, SPEC.store_categories, SPEC.product_categories, invalid="keep"), 2021)
    assert kept.table.count() == 4000
