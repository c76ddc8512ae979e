import heapq
from collections import defaultdict

import pytest

from tests.llm import rows
from tidemark.llm import mixing


def targets(sizes, weights, share, cap):
    """The rule as it is told: deal by weight, stop at the cap, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    want, fixed, left = {}, set(), share * sum(sizes.values())
    while len(fixed) < len(order):
        part = {s: left * w[s] / sum(w[x] for x in order if x not in fixed) for s in order if s not in fixed}
        over = [s for s, t in part.items() if t > cap * sizes[s] + 1e-9]
        if not over:
            want |= part
            break
        for s in over:
            want[s] = cap * sizes[s]
            left -= want[s]
            fixed.add(s)
    return want


def seats(want, n):
    """Sainte-Laguë by a heap of quotients."""
    order = sorted(want, key=lambda s: (s is None, (s or "").encode()))
    heap = [(-want[s], k, s, 0) for k, s in enumerate(order) if want[s] > 0]
    heapq.heapify(heap)
    got = dict.fromkeys(order, 0)
    for _ in range(n if heap else 0):
        _, k, s, j = heapq.heappop(heap)
        got[s] += 1
        heapq.heappush(heap, (-want[s] / (2 * j + 3), k, s, j + 1))
    return got


def table(spark, big):
    sizes = {f"s{k}": n for k, n in enumerate([700, 90, 45, 333, 10, 61, 0, 5])} | {None: 40}
    made = [(s, n // 7 + (k < n % 7)) for s, n in sizes.items() for k in range(7)]
    full = [(i, " ".join(["w"] * (n * big)), s) for i, (s, n) in enumerate(made)]
    return spark.createDataFrame(full, "doc_id long, text string, source string"), {s: n * big for s, n in sizes.items()}


@pytest.mark.parametrize("big", [1, 20])
def test_targets_blocks_and_words(spark, big):
    docs, sizes = table(spark, big)
    out = mixing.mix(docs, block=8).collect()
    want = targets(sizes, (5, 2, 1), 1.5, 2.0)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, blocks = defaultdict(int), {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
        blocks[s] = r.blocks
    assert blocks == seats(want, round(sum(want.values()) / 8))
    assert all(abs(taken[s] - want[s]) <= 8 for s in sizes)


def test_quotas_of_shards_are_differences_of_apportionments(spark):
    docs, sizes = table(spark, 5)
    want = targets(sizes, (5, 2, 1), 1.5, 2.0)
    rows_ = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    quotas = mixing.shard_quotas(mixing.source_targets(rows_, (5, 2, 1), 1.5, 2.0), 16, 4).collect()
    got = {(r.source, r.shard): r.quota for r in quotas}
    total = sum(want.values()) / 16
    for h in range(4):
        now, before = seats(want, round(total * (h + 1) / 4)), seats(want, round(total * h / 4))
        assert {s: got.get((s, h), 0) for s in want} == {s: now[s] - before[s] for s in want}


def test_awkward_rows_and_reruns(spark):
    runs = [sorted(map(str, mixing.mix(rows.docs(spark).repartition(n), block=4).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows.AWKWARD)
    assert mixing.mix(rows.docs(spark, [])).count() == 0
    nothing = mixing.mix(rows.docs(spark, [(1, None), (2, "")])).collect()
    assert [r.taken for r in nothing] == [0, 0]


def test_shards_get_their_quotas(spark):
    docs, sizes = table(spark, 20)
    want = targets(sizes, (5, 2, 1), 1.5, 2.0)
    out = mixing.mix(docs, block=8, shards=4).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    got = defaultdict(int)
    for r in out:
        assert sum(p.words for p in r.shards) == r.taken and all(p.words > 0 for p in r.shards)
        for p in r.shards:
            got[source[r.doc_id], p.shard] += p.words
    total = sum(want.values()) / 8
    for h in range(4):
        now, before = seats(want, round(total * (h + 1) / 4)), seats(want, round(total * h / 4))
        for s in sizes:
            assert got[s, h] == 8 * (now[s] - before[s]) or sum(got[s, k] for k in range(4)) == 2 * sizes[s]  # but for the cap


def test_reruns_agree_on_rows_however_they_are_dealt(spark):
    """Equal sizes, half the ids NULL, some repeated: the texts' hashes decide."""
    words = [f"w{k} " * 5 for k in range(150)]
    table_ = [(None if k % 2 else k % 11, words[k], "ab"[k % 2]) for k in range(150)]
    runs = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(table_, "doc_id long, text string, source string").repartition(parts)
        out = mixing.mix(docs, block=4, carry=True).select("row.doc_id", "row.text", "taken").collect()
        runs.add(tuple(sorted(map(tuple, out), key=str)))
    assert len(runs) == 1 and len(next(iter(runs))) == 150


def test_equal_rows_do_not_share_a_range(spark, monkeypatch):
    """Half of the rows have neither id nor text."""
    monkeypatch.setattr(mixing, "ordered", spy := Spy(mixing.ordered))
    rows_ = spark.range(8000).selectExpr("if(id % 2 = 0, id, NULL) AS doc_id", "if(id % 2 = 0, concat('t', id), NULL) AS text", "'s' AS source")
    mixing.mix(rows_.repartition(6)).count()
    assert max(spy.sizes["mix-rows"]) <= 2 * 8000 / len(spy.sizes["mix-rows"])


class Spy:
    """Counts the rows of each range of the ordered tables."""

    def __init__(self, work):
        self.work, self.sizes = work, {}

    def __call__(self, df, order, label):
        out = self.work(df.repartition(8), order, label)
        self.sizes[label] = [r["count"] for r in out.groupBy("_part").count().collect()]
        return out
