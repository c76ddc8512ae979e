import hashlib
import random
import re
from collections import defaultdict

import pytest

from tests.llm import rows
from tidemark.llm import winnow


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    for i, text in docs:
        w, met = words(text), set()
        hit = [False] * len(w)
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    met |= found
                    hit[k : k + n] = [True] * n
        ids = sorted(str(x) for x in met if x is not None)
        yield i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), any(hit)


def check(spark, docs, items):
    table = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, fp int, n int").repartition(2)
    out = winnow.contamination(rows.docs(spark, docs), table).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(map(tuple, out), key=key) == sorted(brute(docs, items), key=key)


def test_awkward_rows_and_short_items(spark):
    items = [(1, "tok1 tok2"), (2, rows.BASE), (3, None), (4, ""), (5, "TOK5, tok6 tok7!"), (6, "one"), (7, "one"), (None, "a"), (2, rows.BASE)]
    check(spark, rows.AWKWARD, items)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts_of_few_words(spark, seed):
    dice = random.Random(seed)
    text = lambda n: " ".join(dice.choices("abc", k=n))
    items = [(i, text(dice.choice([3, 9, 10, 11, 25, 60]))) for i in range(15)]
    docs = [(i, text(dice.randrange(80))) for i in range(40)]
    docs += [(100 + i, "x y " + items[i][1] + " z " + items[i][1][4:40]) for i in range(15)]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, rows.AWKWARD, [])


def test_kept_fingerprints_cover_every_window():
    import numpy as np

    dice = np.random.default_rng(0)
    for n in (6, 7, 50):
        hashes = dice.integers(0, 4, n).astype(np.uint64)
        at = winnow.kept(hashes, 6)
        assert all(((at >= k) & (at < k + 6)).any() for k in range(n - 5))
    assert len(winnow.kept(hashes[:5], 6)) == 0


def test_a_common_opening_joins_nothing(spark, monkeypatch):
    """Items and documents that share nine words, and so kept fingerprints, but no window: they do not meet."""
    stem = "which of the following is the one right answer"
    items = [(i, f"{stem} " + " ".join(f"i{i}w{k}" for k in range(20))) for i in range(60)]
    docs = [(i, f"d{i} e{i} {stem} " + " ".join(f"d{i}w{k}" for k in range(40))) for i in range(80)]
    docs.append((1000, "so " + items[7][1]))
    table = spark.createDataFrame(items, "item_id long, text string")
    read, spans = winnow.decontaminate(rows.docs(spark, docs).select(winnow.F.col("doc_id").cast("long"), "text"), table)
    found = {(r.doc_id, r.item_id) for r in spans.join(read, "_doc").collect()}
    assert found == {(1000, "7")}
    prints, _ = winnow.item_fingerprints(table)
    of_fp = prints.groupBy("fp").agg(winnow.F.count_distinct("_item").alias("items"), winnow.F.count_distinct("key").alias("keys"))
    most = of_fp.orderBy(winnow.F.desc("items")).first()
    assert most["items"] == 60 and most["keys"] >= 60  # one fingerprint in all items, a window of its own in each
    check(spark, docs, items)
