import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import binning, encoders, indexing
from tidemark.runtime import stage

ROWS = [(1, "b", "x"), (2, "a", "x"), (3, "c", "y"), (4, "c", None), (5, "c", "x")]
NEW = [(6, "a", "y"), (7, "zz", "x"), (8, None, "y")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, k string, m string")


@pytest.fixture(scope="module")
def unseen(spark):
    return spark.createDataFrame(NEW, "id int, k string, m string")


def slots(df, column="k_index"):
    return {r.id: r[column] for r in df.collect()}


def test_slots_follow_frequency_and_value(table):
    got = encoders.fit_index(table, ["k", "m"]).transform(table.where("m IS NOT NULL"))
    assert slots(got) == {1: 2.0, 2: 1.0, 3: 0.0, 5: 0.0} and slots(got, "m_index") == {1: 0.0, 2: 0.0, 3: 1.0, 5: 0.0}


def test_unseen_values_by_rule(table, unseen):
    fit = lambda rule: encoders.fit_index(table, ["k"], rule)
    assert slots(fit("keep").transform(unseen)) == {6: 1.0, 7: 3.0, 8: 3.0} and fit("keep").slots("k") == 4
    assert slots(fit("skip").transform(unseen)) == {6: 1.0}
    with pytest.raises(Exception, match="no slot for k = "):
        fit("error").transform(unseen).collect()
    with pytest.raises(ValueError):
        fit("other")


@pytest.mark.parametrize("rule", ["keep", "skip"])
def test_saved_and_loaded_in_a_pipeline(table, unseen, tmp_path, rule):
    encoder = encoders.fit_index(table, ["k", "m"], rule)
    known = table.where("m IS NOT NULL")
    hot = OneHotEncoder(inputCols=["k_index"], outputCols=["k_vec"]).fit(encoder.transform(known))
    path = str(tmp_path / rule)
    PipelineModel(stages=[encoder, hot]).write().save(path)
    again = PipelineModel.load(path)
    want = {r.id: r.k_vec for r in PipelineModel(stages=[encoder, hot]).transform(unseen).collect()}
    assert {r.id: r.k_vec for r in again.transform(unseen).collect()} == want
    assert again.stages[0].uid == encoder.uid and again.stages[0].slots("k") == encoder.slots("k")


def test_vectors_need_no_list_of_values(table):
    """The width reaches the one-hot encoder as metadata; the values stay in the table."""
    encoder = encoders.fit_index(table, ["k"])
    rows = encoder.transform(table)
    assert rows.schema["k_index"].metadata["ml_attr"] == {"type": "nominal", "name": "k_index", "num_vals": 3}
    hot = OneHotEncoder(inputCols=["k_index"], outputCols=["v"]).fit(rows)
    got = {r.id: list(r.v) for r in hot.transform(rows).select("id", vector_to_array("v").alias("v")).collect()}
    assert got == {1: [0, 0], 2: [0, 1], 3: [1, 0], 4: [1, 0], 5: [1, 0]}


def test_clashing_names_and_numbers_as_categories(spark):
    rows = spark.createDataFrame([(1, 10, 5), (2, 20, 6), (3, 20, 7)], "id int, k int, value int")
    got = encoders.fit_index(rows, ["k", "value"]).transform(rows)
    assert got.columns == ["id", "k", "value", "k_index", "value_index"] and slots(got) == {1: 1.0, 2: 0.0, 3: 0.0}


def test_empty_rows(table):
    assert encoders.fit_index(table, ["k"]).transform(table.limit(0)).count() == 0
    assert encoders.fit_index(table.limit(0), ["k"], "keep").slots("k") == 1


def by_hand(values, target, bins):
    """Bins of each value: in order of mean target, by the rows before it."""
    names = sorted(set(values), key=lambda v: (np.mean([t for w, t in zip(values, target) if w == v]), v))
    before, out = 0, {}
    for v in names:
        out[v] = min(bins - 1, before * bins // len(values))
        before += values.count(v)
    return out


@pytest.mark.parametrize("bins", [2, 7, 256])
def test_bins_hold_equal_shares_in_order_of_the_target(spark, bins):
    dice = np.random.default_rng(3)
    values = [f"v{int(k)}" for k in dice.zipf(1.3, 3000) if k < 500]
    target = [int(x) for x in dice.integers(0, 50, len(values))]
    rows = spark.createDataFrame(list(zip(values, target)), "v string, y int")
    means = stage(binning.category_means(rows, ["v"], "y"), "means")
    assert {r.value: r.bin for r in binning.target_bins(means, bins).collect()} == by_hand(values, target, bins)
    encoder = binning.fit_bins(means, bins)
    assert encoder.slots("v") <= bins
    got = encoder.transform(spark.createDataFrame([("v1",), ("new",), (None,)], "v string")).collect()
    want = by_hand(values, target, bins)
    mean = np.mean(target)
    of = {v: np.mean([t for w, t in zip(values, target) if w == v]) for v in want}
    middle = max(b for v, b in want.items() if of[v] <= mean)
    assert [r.v_bin for r in got] == [want["v1"], middle, middle]


def test_running_totals_over_groups(spark):
    rows = [(g, k, (k * 7) % 11 + 1) for g in "ab" for k in range(200)]
    got = indexing.running_totals(spark.createDataFrame(rows, "g string, k int, n int"), ["g"], [F.desc("k")], "n", "upto")
    for g, k, n, upto in got.collect():
        assert upto == sum(x for h, j, x in rows if h == g and j >= k)
