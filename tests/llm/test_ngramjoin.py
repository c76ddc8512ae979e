import random

import pytest

from tests.llm.rows import AWKWARD, docs, words
from tidemark.llm import ngramjoin


def token_set(text, width):
    w = words(text)
    n = min(width, len(w))
    return frozenset(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, width, least):
    """(doc_id, n_shingles, component_id) of every row (id, text), by all pairs of distinct sets."""
    sets = [token_set(t, width) for _, t in rows]
    distinct = list({s for s in sets if s})
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if min(len(a), len(b)) * 100 >= least * max(len(a), len(b)) and 100 * len(a & b) >= least * len(a | b):
                parent[root(a)] = root(b)
    first = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            first[root(s)] = min(i, first.get(root(s), i))
    return sorted(((i, len(s), first.get(root(s)) if s else i) for (i, _), s in zip(rows, sets)), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"width": 5, "least": 60, "orders": 1, "sample": 1}, {"least": 100}])
def test_awkward_rows(spark, options):
    rows = docs(spark)
    got = ngramjoin.ngram_join(rows, **options)
    assert found(got) == brute(pairs(rows), options.get("width", 3), options.get("least", 90))


def edited(dice, base, share):
    """The words of ``base`` with about ``share`` of them exchanged, and a few cut from the end."""
    out = [w if dice.random() >= share else f"x{dice.randrange(10**6)}" for w in base]
    return out[: len(out) - dice.randrange(0, 4)]


@pytest.mark.parametrize("options", [{"block": 5}, {"least": 80, "block": 16, "sample": 2}])
def test_edited_copies(spark, options):
    """Groups of copies with few and many edits, near the threshold, so that lists hold several components."""
    dice = random.Random(4)
    common = [f"c{k}" for k in range(25)]
    texts = []
    for g in range(12):
        base = [f"g{g}w{dice.randrange(400)}" for _ in range(dice.choice([9, 12, 60, 150]))]
        for _ in range(15):
            texts.append(edited(dice, base, dice.choice([0, 0.005, 0.01, 0.03])))
        texts.append(base + common)
    rows = [(dice.randrange(10**6), " ".join(t)) for t in texts]
    got = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options)
    want = brute(rows, 3, options.get("least", 90))
    assert found(got) == want and len({c for _, _, c in want}) > 20


def chained(n):
    """Texts whose neighbours alone are similar: each moves on by a few words."""
    line = [f"w{k}" for k in range(n * 4 + 100)]
    return [(i, " ".join(line[i * 4 : i * 4 + 100])) for i in range(n)]


def test_links_reach_along_a_chain(spark):
    rows = chained(60)
    got = found(ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=8))
    assert got == brute(rows, 3, 90) and {c for _, _, c in got} == {0}


@pytest.mark.parametrize("block", [7, 1000])
def test_lists_with_several_components_in_blocks(spark, monkeypatch, block):
    """With stars that find nothing every link comes from the cells: enough of them, and fewer than members."""
    dice = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(edited(dice, base, 0.008))) for i in range(80)]
    sets = ngramjoin.live_sets(spark.createDataFrame(rows, "doc_id long, text string"), live_of(spark, rows), 3)
    monkeypatch.setattr(ngramjoin, "verified", lambda pairs, sets, least: pairs.limit(0))
    made = [(r["a"], r["b"]) for r in ngramjoin.links_of(sets, block=block).collect()]
    kept = {r["node"]: set(r["tokens"]) for r in sets.collect()}
    alike = lambda a, b: 100 * len(kept[a] & kept[b]) >= 90 * len(kept[a] | kept[b])
    assert all(alike(a, b) for a, b in made)
    parts = {frozenset(p) for p in joined(kept, made)}
    assert parts == {frozenset(p) for p in joined(kept, [(a, b) for a in kept for b in kept if a < b and alike(a, b)])}
    assert max(map(len, parts)) > 20


def joined(nodes, links):
    part = {n: {n} for n in nodes}
    for a, b in links:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for n in part[b]:
                part[n] = part[a]
    return list({id(p): p for p in part.values()}.values())


def live_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return ngramjoin.rows_with_keys(frame, 3).select("node", "key", ngramjoin.F.col("n_shingles").alias("n")).distinct()


def test_a_shared_template_makes_no_lists(spark):
    """Texts that share most of their words but too few to link have their own words first in every order."""
    shared = " ".join(f"s{k}" for k in range(120))
    rows = [(i, shared + " " + " ".join(f"own{i}x{k}" for k in range(70))) for i in range(300)]
    sets = ngramjoin.live_sets(spark.createDataFrame(rows, "doc_id long, text string"), live_of(spark, rows), 3)
    assert sets.count() == 300 and ngramjoin.prefixes(sets, 90, 3).count() == 0


def test_empty_table(spark):
    got = ngramjoin.ngram_join(docs(spark, []))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_id"] and got.count() == 0
    wordless = ngramjoin.ngram_join(docs(spark, [(1, None), (2, ""), (None, " ")]))
    assert found(wordless) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


def test_other_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        ngramjoin.ngram_join(docs(spark, AWKWARD), least=0)
