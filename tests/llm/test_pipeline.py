"""The stages on the small tables beside a brute-force version, and each on awkward rows."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.conftest import SMALL
from tests.llm import rows
from tests.llm.test_neardup import brute as components_of
from tests.llm.test_winnow import brute as contamination_of
from tidemark.llm import mixing, sharding, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def listed(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, work in pipeline.STAGES:
        docs = work(spark, docs, SMALL).persist()
        out.append(docs)
    return out


def test_toxic_documents_go(spark, steps):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.train_part(docs), toxicity.train_part(labels))
    scored = toxicity.score(spark, docs, model)
    assert listed(steps[0]) == listed(scored.where("score < 0.5")) and steps[0].columns == COLUMNS


def test_one_of_each_group_stays(steps):
    table = [(r.doc_id, r.text) for r in steps[0].collect()]
    first = components_of(table)
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(i for i in first if first[i] == i)


def test_contaminated_documents_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [i for i, *_, bad in contamination_of([(r.doc_id, r.text) for r in steps[1].collect()], items) if not bad]
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(clean)


def test_mix_repeats_documents(steps):
    plan = mixing.mix(steps[2]).collect()
    want = {r.doc_id: (2 * r.taken + r["size"]) // (2 * r["size"]) if r["size"] else 0 for r in plan}
    assert Counter(r.doc_id for r in steps[3].collect()) == Counter({i: n for i, n in want.items() if n})


def test_shards_hold_every_row(steps):
    assert steps[4].columns == [*COLUMNS, "shard", "slot"] and listed(steps[4]) == listed(steps[3])
    plain = sharding.shard_documents(steps[3], pipeline.SHARDS)
    assert sorted(map(tuple, steps[4].select("doc_id", "shard", "slot").collect())) == sorted(
        map(tuple, plain.select("doc_id", "shard", "slot").collect())
    )


def test_run_applies_all_stages(spark, steps):
    got = pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.select("doc_id", "shard", "slot").collect())) == sorted(
        map(tuple, steps[4].select("doc_id", "shard", "slot").collect())
    )


@pytest.mark.parametrize("name, work", pipeline.STAGES)
def test_awkward_rows(spark, name, work):
    docs = rows.docs(spark)
    out = work(spark, docs, SMALL)
    extra = ["_shard", "slot"] if name == "sharding" else []
    assert out.columns == docs.columns + extra
    kept = Counter(r.doc_id for r in out.collect())
    if name == "near duplicates":
        assert kept == Counter({i: 1 for i in (1, 4, 5, 6, 7, 9, 11, 12, -3)} | {None: 2})
    if name == "benchmark decontamination":
        assert kept == Counter(i for i, _ in rows.AWKWARD)
    if name == "sharding":
        assert out.count() == len(rows.AWKWARD)
    assert work(spark, docs.limit(0), SMALL).count() == 0


def test_contamination_is_judged_by_row(spark):
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    bad = [(None, passage), (7, passage), (8, f"before {passage} after")]
    clean = [(None, rows.BASE), (None, None), (7, rows.NEAR), (9, "a b c")]
    out = pipeline.drop_contaminated(spark, rows.docs(spark, bad + clean), SMALL)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(clean)


def test_near_duplicates_are_judged_by_row(spark):
    other = "quite another text of more than five words that shares no run with the first " * 2
    table = [(7, rows.BASE), (7, other), (7, rows.NEAR), (8, other + "end"), (9, rows.BASE), (3, "a b c"), (3, "d e f")]
    table += [(None, rows.BASE), (None, rows.BASE), (None, rows.NEAR), (None, None), (None, "x y z"), (None, "x y z")]
    out = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, rows.docs(spark, table), SMALL).collect()]
    base = {rows.BASE, rows.NEAR}
    assert Counter((i, "base" if t in base else t) for i, t in out) == Counter(
        [(7, "base"), (7, other), (3, "a b c"), (3, "d e f"), (None, "base"), (None, None), (None, "x y z")]
    )
