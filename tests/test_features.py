import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import features, indexing, stats
from tidemark.sources import standin


def test_index_order_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "x string")
    got = {r.value: r.idx for r in indexing.category_index(df, ["x"]).collect()}
    assert got == {"c": 0, "a": 1, "b": 2}


def test_index_equals_indexer(spark, folder):
    parts = standin.products(spark, folder, "sparse")
    index = indexing.category_index(parts, features.PRODUCT_CATEGORIES)
    for c in features.PRODUCT_CATEGORIES:
        labels = StringIndexer(inputCol=c, outputCol="i").fit(parts).labels
        got = [r.value for r in index.where(F.col("feature") == c).orderBy("idx").collect()]
        assert got == list(labels)


@pytest.mark.parametrize("n", [1, 50, 5000])
def test_numbering_without_gaps(spark, n):
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.hash("id").alias("v"), "id")
    got = indexing.number_rows(df, ["g"], [F.desc("v"), "id"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["v", "id"], ascending=[False, True])
        assert list(part.idx) == list(range(len(part)))
    whole = indexing.number_rows(df, [], ["id"]).toPandas()
    assert (whole.idx == whole.id).all()


def test_one_hot_slots_equal_encoder(spark, folder):
    stores = standin.stores(spark, folder, "sparse")
    columns = ["region", "city"]
    index = StringIndexer(inputCols=columns, outputCols=["ri", "ci"]).fit(stores).transform(stores)
    vectors = OneHotEncoder(inputCols=["ri", "ci"], outputCols=["rv", "cv"]).fit(index).transform(index)
    want = set()
    for r in vectors.select("store_id", vector_to_array("rv").alias("rv"), vector_to_array("cv").alias("cv")).collect():
        for name, v in (("region", r.rv), ("city", r.cv)):
            want.add((r.store_id, name, v.index(1.0) if 1.0 in v else None))
    got = {tuple(r) for r in indexing.one_hot_slots(stores, "store_id", columns).collect()}
    assert got == want


def test_single_value_column_is_skipped(spark):
    df = spark.createDataFrame([(1, "SP", "x"), (2, "SP", "y")], "store_id int, state string, city string")
    encoded, usable = features.encode(df, ["state", "city"])
    assert usable == ["city"] and "state_vec" not in encoded.columns
    assert {r.feature for r in indexing.one_hot_slots(df, "store_id", ["state", "city"]).collect()} == {"city"}


def test_null_category(spark):
    df = spark.createDataFrame([(1, "N"), (2, None), (3, "S")], "store_id int, region string")
    with pytest.raises(Exception):
        features.encode(df, ["region"], invalid="error")[0].collect()
    encoded, usable = features.encode(df, ["region"], invalid="keep")
    assert usable == ["region"] and encoded.count() == 3


def test_joint_scaling_equals_single_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), 7.0) for a, b in rng.normal(5, 2, (200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    joint = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features_raw").transform(df)
    joint = features.unit_scaler("features_raw").fit(joint).transform(joint)
    joint = joint.select("a", vector_to_array("features").alias("f")).toPandas().sort_values("a")
    plain = features.scale_columns(df, ["a", "b", "c"]).toPandas().sort_values("a")
    for i, c in enumerate("abc"):
        alone = VectorAssembler(inputCols=[c], outputCol="v").transform(df)
        alone = StandardScaler(inputCol="v", outputCol="s").fit(alone).transform(alone)
        alone = alone.select("a", vector_to_array("s")[0].alias("s")).toPandas().sort_values("a")
        np.testing.assert_allclose([f[i] for f in joint.f], alone.s)
        np.testing.assert_allclose(plain[f"{c}_scaled"], alone.s)


def test_hashed_slots(spark):
    # texts "column=value" of four bytes, for which the hasher and the SQL function agree
    df = spark.createDataFrame([("xx", "pp"), ("yy", "qq"), ("xx", "qq")], "a string, b string")
    hashed = features.hash_categories(df, ["a", "b"], 16).select(
        vector_to_array("hashed_vec").alias("h"),
        *[F.pmod(F.hash(F.concat(F.lit(f"{c}="), F.col(c))), F.lit(16)).alias(c) for c in "ab"],
    )
    for r in hashed.collect():
        want = np.zeros(16)
        want[r.a] += 1
        want[r.b] += 1
        assert list(want) == r.h


def test_correlation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = 0.5 * x + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), 0.1) for a, b in zip(x, y)], "x double, y double, k double")
    got = {(r.col_a, r.col_b): r.corr for r in stats.correlation_matrix(df, ["x", "y", "k"]).collect()}
    assert len(got) == 9
    assert got["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1]) == got["y", "x"]
    assert got["x", "x"] == 1.0
    assert got["k", "k"] is None and got["x", "k"] is None
    pairs = stats.collinear_pairs(stats.correlation_matrix(df, ["x", "y", "k"]), 0.3)
    assert stats.keep_independent(["x", "y", "k"], pairs) == ["x", "k"]


def test_rmse_counts_coverage(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, 8.0)], "y double, p double")
    r = stats.rmse(df, "y", "p").first()
    assert (r.n_rows, r.n_scored) == (3, 2)
    assert r.rmse == pytest.approx(np.sqrt((1 + 9) / 2))
