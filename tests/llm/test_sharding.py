import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tests.llm import rows
from tidemark.llm import sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, None
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def check(spark, table, shards):
    out = sharding.shard_documents(rows.docs(spark, table), shards).collect()
    assert len(out) == len(table)
    groups, loads, slots = defaultdict(int), defaultdict(int), defaultdict(list)
    for i, text in table:
        groups[hashlib.sha256((text or "").encode()).digest()] += len((text or "").encode()) + 1
    for r in out:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    order = [groups[k] for k in sorted(groups)]
    assert max(loads.values()) == least_capacity(order, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in out} == {"bytes"} and set(slots) <= set(range(shards))
    by_text = defaultdict(set)
    for r in out:
        by_text[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in table)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in out) == want
    return loads


def test_awkward_rows(spark):
    check(spark, rows.AWKWARD, 8)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_groups_with_one_hot(spark, seed):
    dice = random.Random(seed)
    table = [(i, "hot" * 40 if dice.random() < 0.3 else f"{dice.random()}" * dice.randrange(1, 30)) for i in range(400)]
    loads = check(spark, table, 5)
    assert len(loads) == 5


def test_fewer_groups_than_shards_and_none(spark):
    check(spark, [(1, "a"), (2, "b"), (3, "a")], 8)
    assert sharding.shard_documents(rows.docs(spark, []), 8).count() == 0


def test_carries_rows(spark):
    out = sharding.shard_documents(rows.docs(spark), 4, carry=True).select("row.*")
    assert out.columns == rows.docs(spark).columns
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.docs(spark).collect()))


def test_equal_rows_do_not_share_a_range(spark, monkeypatch):
    from tests.llm.test_mixing import Spy

    monkeypatch.setattr(sharding, "ordered", spy := Spy(sharding.ordered))
    rows_ = spark.range(8000).selectExpr("if(id % 2 = 0, id, NULL) AS doc_id", "if(id % 2 = 0, concat('t', id), NULL) AS text")
    out = sharding.shard_documents(rows_.repartition(6), 4)
    assert out.count() == 8000 and max(spy.sizes["shard-rows"]) <= 2 * 8000 / len(spy.sizes["shard-rows"])
