import math
import re
from collections import Counter

import pytest

from tests.llm.rows import docs
from tidemark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [("a", "tok1 tok2 Tok3 tok1"), ("b", "three words one unrelated"), ("b", "W5x5 w6x6 nobody"), (None, "日本 tok2"), ("c", None), ("d", ""), ("a", "tok1 tok2 Tok3 tok1"), ("e", "absent")]


def terms(text):
    return TERM.findall((text or "").encode().lower().decode())


def brute(rows, items, k):
    """Scores of every row (id, text) for every item, k best each, as sorted (item_id, [(rank, doc_id, score)])."""
    bags = [(i, Counter(terms(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // n_all
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t in terms(text)
                if t in bag
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda f: f[:3])
        if found:
            out.append((item, [(r, i, -s) for r, (s, _, _, i) in enumerate(found[:k], 1)]))
    return sorted(out, key=repr)


def lists(df):
    by_item = {}
    for r in df.collect():
        by_item.setdefault((r["_item"], r["item_id"]), []).append((r["rank"], r["doc_id"], r["score"]))
    return sorted(((item, sorted(found)) for (_, item), found in by_item.items()), key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"bits": 1}, {"block": 4}, {"k": 1}, {"k": 2, "bits": 0}])
def test_awkward_rows(spark, options):
    rows = docs(spark)
    items = spark.createDataFrame(ITEMS, "item_id string, text string").withColumn("doc_id", ranked.F.lit(1))
    found = lists(ranked.ranked_documents(rows, items, **options))
    assert found == brute(pairs(rows), ITEMS, options.get("k", ranked.BEST))


def test_whole_numbers_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(ranked, "EXACT", 0)
    rows, items = docs(spark), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lists(ranked.ranked_documents(rows, items)) == brute(pairs(rows), ITEMS, ranked.BEST)


def test_many_copies_of_one_text(spark):
    texts = [(i, "common passage of all" if i % 3 else f"common word{i % 7} own{i}") for i in range(600)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    items = [("x", "common passage"), ("y", "word3 common"), ("z", "own300 own9 word2")]
    found = ranked.ranked_documents(rows, spark.createDataFrame(items, "item_id string, text string"))
    assert lists(found) == brute(texts, items, ranked.BEST)
    assert found.where("item_id = 'x'").select("class").distinct().count() == 1  # one score for all copies


def test_only_few_members_of_a_class_are_shuffled(spark):
    rows = spark.createDataFrame([(1, 1, 80, b"a", b"b", 1)], "doc_id long, key long, m long, terms binary, tfs binary, _doc long")
    assert "WindowGroupLimit" in ranked.classes_of(rows, 20)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    none, some = docs(spark, []), spark.createDataFrame(ITEMS, "item_id string, text string")
    for rows, items in ((none, some), (docs(spark), some.limit(0)), (docs(spark, [(1, None), (2, "?")]), some)):
        got = ranked.ranked_documents(rows, items)
        assert got.columns == ["_item", "item_id", "rank", "doc_id", "score", "class"] and got.count() == 0
