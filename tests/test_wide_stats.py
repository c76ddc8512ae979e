import numpy as np
import pytest

from tidemark.operators import stats


def frame(spark, x):
    names = [f"c{k}" for k in range(x.shape[1])]
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names


def as_matrix(df, names):
    place = {n: i for i, n in enumerate(names)}
    out, n = np.full((len(names),) * 2, np.nan), np.zeros((len(names),) * 2)
    for r in df.collect():
        out[place[r.col_a], place[r.col_b]] = np.nan if r.corr is None else r.corr
        n[place[r.col_a], place[r.col_b]] = r.n if "n" in r else 0
    return out, n


def test_wide_equals_pairs_of_300_columns(spark):
    dice = np.random.default_rng(0)
    x = dice.normal(size=(500, 300)) + dice.normal(size=(500, 1)) + 1000.0
    df, names = frame(spark, x)
    got, n = as_matrix(stats.wide_correlation(df.repartition(5), names), names)
    np.testing.assert_allclose(got, np.corrcoef(x.T), atol=1e-9)
    assert (n == 500).all() and (np.diag(got) == 1).all()


def test_wide_equals_the_pair_form_with_nulls(spark):
    dice = np.random.default_rng(1)
    x = dice.normal(size=(200, 70))
    x[dice.random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:, 4] = 5.0, np.nan
    x[:198, 5] = np.nan
    df, names = frame(spark, x)
    some = names[:8] + names[60:]
    want, _ = as_matrix(stats.correlation_matrix(df, some), some)
    got, n = as_matrix(stats.wide_correlation(df, some), some)
    np.testing.assert_allclose(got, want, atol=1e-9)
    known = ~np.isnan(x[:, [names.index(c) for c in some]])
    assert (n == known.astype(int).T @ known.astype(int)).all()


def test_wide_correlation_of_no_rows_and_too_many_columns(spark, monkeypatch):
    df, names = frame(spark, np.zeros((1, 3)))
    assert stats.wide_correlation(df.limit(0), names).count() == 0
    assert {r.corr for r in stats.wide_correlation(df, names).collect()} == {None}
    monkeypatch.setattr(stats, "WIDEST", 2)
    with pytest.raises(ValueError):
        stats.wide_correlation(df, names)


def swept(spark, x, most=10.0):
    df, names = frame(spark, x)
    found = stats.variance_inflation(stats.wide_correlation(df, names), names, most).orderBy("position").collect()
    return {r.column: r for r in found}


def test_inflation_is_that_of_the_regression_on_kept_columns(spark):
    dice = np.random.default_rng(2)
    x = dice.normal(size=(400, 4))
    x = np.column_stack([x, x[:, 0] + 0.6 * x[:, 1] + 0.5 * dice.normal(size=400)])
    got = swept(spark, x, most=100)
    centred = x - x.mean(axis=0)
    for k in range(5):
        before = centred[:, :k]
        rest = centred[:, k] - (before @ np.linalg.lstsq(before, centred[:, k], rcond=None)[0] if k else 0)
        assert got[f"c{k}"].inflation == pytest.approx((centred[:, k] ** 2).sum() / (rest**2).sum(), rel=1e-8) and got[f"c{k}"].kept


def test_a_sum_of_two_columns_is_dropped(spark):
    """No two columns are alike, which is all that pairs show; the third follows from both."""
    dice = np.random.default_rng(3)
    x = dice.normal(size=(300, 2))
    x = np.column_stack([x, x.sum(axis=1), np.full(300, 2.0), dice.normal(size=300)])
    df, names = frame(spark, x)
    assert stats.collinear_pairs(stats.wide_correlation(df, names), 0.9).count() == 0
    assert [c for c, r in swept(spark, x).items() if r.kept] == ["c0", "c1", "c4"]
