import numpy as np
import pytest

from tests.llm import rows
from tidemark.llm import hashed, ordinal, toxicity

FOLDER = "/root/testdata/sf0.1"


def sparse(x):
    slots = [np.flatnonzero(r).astype(np.int64) for r in x]
    return hashed.Rows(slots, [r[s] for r, s in zip(x, slots, strict=True)], x.shape[1])


def test_sparse_products_match_dense_ones():
    dice = np.random.default_rng(0)
    x = dice.random((5, 7)) * (dice.random((5, 7)) < 0.5)
    w, each = dice.random(7), dice.random(5)
    assert np.allclose(sparse(x).dot(w), x @ w) and np.allclose(sparse(x).back(each), x.T @ each)
    assert np.allclose(sparse(x).only(np.array([2, 5])).dot(w[:2]), x[:, [2, 5]] @ w[:2])


def test_shapes_and_rows_of_empty_texts():
    assert hashed.shapes("THE!! of%%% | a12 é") == [b"A!", b"a%", b"|", b"a0", b"a"]
    assert len(hashed.Featurizer(8, True).row(None)[0]) == len(hashed.Featurizer(8, True).row(" ")[0]) == 0


def test_ordinal_recovers_ordered_grades():
    dice = np.random.default_rng(1)
    x = dice.normal(size=(3000, 4))
    score = x @ np.array([2.0, -1.0, 0.5, 0.0]) + dice.logistic(size=3000)
    grades = np.digitize(score, [-2, 0, 1.5])
    model = ordinal.fit(sparse(x), grades, epochs=400, rate=0.1)
    assert (np.diff(model.thresholds) > 0).all() and np.allclose(model.thresholds, [-2, 0, 1.5], atol=0.4)
    assert np.allclose(model.weights, [2, -1, 0.5, 0], atol=0.25)
    sums = x @ model.weights
    reaching = model.reaching(sums)
    assert (np.diff(reaching, axis=1) <= 0).all() and np.corrcoef(model.expected(sums), grades)[0, 1] > 0.7


def test_ordinal_slope_is_that_of_the_likelihood():
    x, y = np.eye(3), np.array([0, 1, 2])
    model = ordinal.fit(sparse(np.repeat(x, 5, axis=0)), np.repeat(y, 5), epochs=200)
    expected = model.expected(np.eye(3) @ model.weights)
    assert expected[0] < expected[1] < expected[2]


def test_unlabelled_risk_is_not_driven_below_zero():
    dice = np.random.default_rng(2)
    marked = dice.random(400) < 0.3
    x = (dice.random((400, 30)) < 0.3) * 1.0
    x[:, 0] = marked
    model = toxicity.fit(sparse(x[marked][:60]), sparse(x[~marked | (np.arange(400) % 2 == 0)]), 0.15)
    scores = toxicity.sigmoid(x @ model.weights + model.bias)
    assert ((scores >= 0.5) == marked).mean() > 0.97
    none = toxicity.fit(sparse(x[:0]), sparse(x), 0.2)
    assert abs(toxicity.sigmoid(np.array(none.bias)) - 0.2) < 1e-9


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")]


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    got = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").toPandas()
    assert got.predicted[got.toxic == 1].mean() > 0.8 and got.predicted[got.toxic == 0].mean() < 0.01


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    got = ordinal.quality_grades(docs, labels).where("held_out").join(labels, "doc_id").select("quality", "selected").toPandas()
    assert got.selected[got.quality == 1].mean() > 0.97 and got.selected[got.quality == 0].mean() < 0.25


@pytest.mark.parametrize("labelled", [[], [(1, 1, None), (None, 0, 1), (9, None, 1)], [(i, i % 2, i % 3 == 0) for i in range(12)]])
def test_awkward_rows(spark, labelled):
    labels = rows.labels(spark, [(i, q, None if t is None else int(t)) for i, q, t in labelled])
    docs = rows.docs(spark)
    tox = toxicity.toxicity_scores(docs, labels).collect()
    assert len(tox) == len(rows.AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in tox)
    graded = ordinal.quality_grades(docs, labels).collect()
    assert len(graded) == len(rows.AWKWARD) and all(0 <= r.tail_probability <= 1 for r in graded)
    assert toxicity.toxicity_scores(rows.docs(spark, []), labels).count() == 0
    assert ordinal.quality_grades(rows.docs(spark, []), labels).count() == 0


def dense_features(texts, bits):
    """Counts of words by slot, 1 + log, scaled to length 1: the features as they are told, a row per text."""
    import re

    import xxhash

    x = np.zeros((len(texts), 1 << bits))
    for i, text in enumerate(texts):
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
            x[i, xxhash.xxh3_64_intdigest(w) >> (64 - bits)] += 1
        x[i] = np.where(x[i] > 0, 1 + np.log(np.maximum(x[i], 1)), 0)
        x[i] /= max(np.linalg.norm(x[i]), 1e-300)
    return x


def adam(params, slopes_of, steps, rate):
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(params, slopes_of(), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def test_toxicity_scores_are_those_of_a_dense_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 12)
    dice = np.random.default_rng(8)
    bad, plain = [f"bad{k}" for k in range(8)], [f"w{k}" for k in range(60)]
    texts = [" ".join(dice.choice(bad + plain if i % 5 == 0 else plain, 12)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, toxicity.train(docs, labels)).collect()}

    x = dense_features(texts, 12)
    p = np.unique(x[[i for i in range(0, 300, 2) if i % 5 == 0]], axis=0)
    u = np.unique(x[[i for i in range(300) if i % 2 or i % 5]], axis=0)
    prior, confirmed = 0.2, 30
    left = (prior * 300 - confirmed) / (300 - confirmed)
    a, b = (p > 0).sum(axis=0), (u > 0).sum(axis=0)
    n, m = len(p), len(u)
    share = np.clip((a + b) / (n + m), 1e-9, 1 - 1e-9)
    z = np.maximum(0, np.abs(a / n - b / m) - 0.5 * (1 / n + 1 / m)) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    scale = np.where(a + b >= 4, np.maximum(0, z - 3.0), 0)
    w, bias = np.zeros(x.shape[1]), np.array([np.log(prior / (1 - prior))])
    soft = lambda f: np.logaddexp(0, f)
    sig = lambda f: 1 / (1 + np.exp(-f))

    def slopes():
        fp, fu = p @ (w * scale) + bias, u @ (w * scale) + bias
        negative = soft(fu).mean() - left * soft(fp).mean()
        part = (1 - prior) / (1 - left)
        of_negative = [(part * sig(fu) / m), (-part * left * sig(fp) / n)]
        of_positive = prior * (sig(fp) - 1) / n
        gu, gp = (of_negative[0], of_positive + of_negative[1]) if negative >= 0 else (-of_negative[0], -of_negative[1])
        return [scale * (p.T @ gp + u.T @ gu) + 1e-5 * w, np.array([gp.sum() + gu.sum()])]

    adam([w, bias], slopes, 100, 0.3)
    want = sig(x @ (w * scale) + bias)
    np.testing.assert_allclose([got[i] for i in range(300)], want, atol=2e-4)
    assert want[np.arange(300) % 5 == 0].mean() > want[np.arange(300) % 5 > 0].mean() + 0.3


def test_quality_grades_are_those_of_a_dense_fit(spark, monkeypatch):
    monkeypatch.setattr(ordinal, "BITS", 12)
    monkeypatch.setattr(hashed, "shapes", lambda text: [])  # the words alone
    dice = np.random.default_rng(9)
    grade = dice.integers(0, 3, 240)
    texts = [" ".join([f"g{g}"] * 3 + list(dice.choice([f"w{k}" for k in range(40)], 10))) for g in grade]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grade)], "doc_id long, grade int")
    model = ordinal.train(docs, labels, "grade")

    x = dense_features(texts, 12)
    rows_ = sorted({(int(g), r.tobytes()) for g, r in zip(grade, x)})
    y, x1 = np.array([g for g, _ in rows_]), np.array([np.frombuffer(r) for _, r in rows_])
    used = (x1 > 0).sum(axis=0) >= 4
    x1 = x1[:, used]
    below = np.cumsum(np.bincount(y))[:-1] / len(y)
    start = np.log(below / (1 - below))
    w, first, gap = np.zeros(used.sum()), start[:1].copy(), np.log(np.diff(start))
    sig = lambda f: 0.5 * (1 + np.tanh(0.5 * f))

    def loss(w, first, gap):
        cuts = np.array([-np.inf, first[0], first[0] + np.exp(gap[0]), np.inf])
        s = x1 @ w
        with np.errstate(over="ignore"):
            return -np.log(np.maximum(sig(cuts[y + 1] - s) - sig(cuts[y] - s), 1e-9)).mean()

    def slopes():
        """The thresholds by differences, the weights by the chain rule of the same loss."""
        cuts = np.array([-np.inf, first[0], first[0] + np.exp(gap[0]), np.inf])
        s = x1 @ w
        up, low = sig(cuts[y + 1] - s), sig(cuts[y] - s)
        gw = x1.T @ ((up * (1 - up) - low * (1 - low)) / np.maximum(up - low, 1e-9)) / len(y)
        e = 1e-6
        by = lambda d, g: (loss(w, first + d, gap + g) - loss(w, first - d, gap - g)) / (2 * e)
        return [gw + 1e-5 * w, np.array([by(e, 0)]), np.array([by(0, e)])]

    adam([w, first, gap], slopes, 120, 0.2)
    np.testing.assert_allclose(model.weights[used], w, atol=2e-2)
    np.testing.assert_allclose(model.thresholds, [first[0], first[0] + np.exp(gap[0])], atol=2e-2)
    sums = x @ model.weights
    reach = 1 - sig(model.thresholds[None] - sums[:, None])
    got = {r.doc_id: r for r in ordinal.graded(docs, model).collect()}
    np.testing.assert_allclose([got[i].expected_grade for i in range(240)], reach.sum(axis=1), atol=1e-5)
    assert (np.round(reach.sum(axis=1)) == grade).mean() > 0.95


def test_complete_labels_still_teach(spark):
    dice = np.random.default_rng(4)
    texts = [" ".join(dice.choice(["vile", "nasty", "foul"] if i % 5 == 0 else [f"w{k}" for k in range(50)], 10)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(got[i] == (i % 5 == 0) for i in range(400))
    with pytest.raises(ValueError, match="no other documents"):
        toxicity.train(docs.where("doc_id % 5 = 0"), labels)


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(k % 2, f"text number {k}") for k in range(500)], "doc_id long, text string")
    wanted = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    got = hashed.collect_rows(docs, wanted, 10, False)
    assert got["marks"].tolist() == [0, 1]
    first = [min((t for k in range(i, 500, 2) for t in [f"text number {k}"]), key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()) for i in (1, 0)]
    want = [set(hashed.Featurizer(10).row(t)[0].tolist()) for t in first]
    assert [set(s.tolist()) for s in got["slots"]] == want
