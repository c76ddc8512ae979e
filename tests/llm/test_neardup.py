import random
from collections import defaultdict
from itertools import combinations

import pytest

from tests.llm import rows
from tidemark.llm import neardup
from tidemark.llm.graph import components


def sets_of(table):
    out = {}
    for i, text in table:
        w = rows.words(text)
        out.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(table):
    """Component of each id over all pairs of texts."""
    sets = [(i, s) for i, all_ in sets_of(table).items() for s in all_ if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def check(spark, table):
    out = neardup.near_duplicates(rows.docs(spark, table)).collect()
    want = brute(table)
    assert len(out) == len(table)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id) for r in out)
    sizes = defaultdict(list)
    for i, all_ in sets_of(table).items():
        sizes[i] = sorted(len(s) for s in all_)
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r.n_shingles)
    assert {i: sorted(v) for i, v in got.items()} == sizes


def test_awkward_rows(spark):
    check(spark, rows.AWKWARD)


def edited(dice, words, share):
    return " ".join(w if dice.random() > share else f"e{dice.randrange(10**6)}" for w in words)


def test_a_large_component_is_a_row_a_member(spark, monkeypatch):
    """In a list of one large component and few others, members of the large one meet the others' blocks alone."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    table = [(k, k, 7, 0) for k in range(640)] + [(700 + k, 700 + k, 7, 700 + k) for k in range(3)] + [(k, k, 8, 0) for k in range(9)]
    got = neardup.blocks_met(spark.createDataFrame(table, "_doc long, node long, key long, component long")).collect()
    assert len(got) == 643 and sum(len(r["_others"]) for r in got) == 640 + 3 * 81
    met = {frozenset((r.block, o)) for r in got for o in r["_others"]}
    assert all(frozenset((a.block, b.block)) in met for a in got for b in got[-40:] if a.component != b.component)


def test_lists_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    test_groups_of_edited_copies_and_a_common_passage(spark, 5)


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_of_edited_copies_and_a_common_passage(spark, seed):
    dice = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    table = []
    for _ in range(12):
        base = [f"b{dice.randrange(10**6)}" for _ in range(dice.randrange(20, 200))]
        table += [edited(dice, base, dice.choice([0, 0.005, 0.01, 0.02, 0.05])) for _ in range(12)]
    hub = [f"h{i}" for i in range(150)]
    table += [edited(dice, hub, 0.02) for _ in range(60)]
    table += [passage + " " + " ".join(f"u{dice.randrange(10**6)}" for _ in range(dice.randrange(5, 60))) for _ in range(80)]
    table += [" ".join(dice.choices("abc", k=dice.randrange(1, 6))) for _ in range(40)]
    dice.shuffle(table)
    check(spark, list(enumerate(table)))


def test_blocks_smaller_than_a_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    dice = random.Random(5)
    hub = [f"h{i}" for i in range(120)]
    check(spark, list(enumerate(edited(dice, hub, 0.03) for _ in range(60))))


def test_empty_table_and_one_row(spark):
    assert neardup.near_duplicates(rows.docs(spark, [])).count() == 0
    check(spark, [(5, "alone here")])


def test_components_of_paths_loops_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 95), (100, 90)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def template_texts(n):
    """Texts that share 120 of 190 words, below the threshold."""
    shared = " ".join(f"s{k}" for k in range(120))
    return [(i, shared + " " + " ".join(f"own{i}x{k}" for k in range(70))) for i in range(n)]


def test_templates_below_the_threshold_are_not_paired(spark, monkeypatch):
    seen = []
    real = neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, label: seen.append((label, out := real(df, label))) or out)
    with neardup.working():
        found = neardup.linked(spark.createDataFrame(template_texts(400), "doc_id long, text string"), "doc_id")
        assert found.where("component != doc_id").count() == 0
    assert dict(seen)["dup-live"] is not None and [label for label, _ in seen].count("dup-able-prefix") == 1


def test_unlike_texts_of_one_id_do_not_hide_each_other(spark):
    """What one text of an id has to itself does not count for its other text."""
    base = " ".join(f"t{k}" for k in range(40))
    near = base.replace("t20", "other")
    check(spark, [(5, base), (5, " ".join(f"x{k}" for k in range(300))), (6, near), (7, near + " end"), (6, "x1 x2 x3 x4 x5 x6 x7 x8 x9")])


def test_own_shingles_are_those_of_one_text(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (3, [3, 5, 6, 7])], "_doc long, shingles array<long>")
    assert {r._doc: r.own for r in neardup.own_shingles(sets).collect()} == {1: 2, 2: 1, 3: 3}


def test_no_link_is_lost_beside_an_exact_join(spark):
    """All documents of sf0.1 against the prefix-filter join, which can lose none."""
    from tidemark.llm.ngramjoin import ngram_join

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ours = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    exact = {r.doc_id: r.component_id for r in ngram_join(docs, width=5, least=75).collect()}
    assert ours == exact and len(ours) == 10_000 and sum(i != c for i, c in exact.items()) > 500
