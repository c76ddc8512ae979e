import random

import pytest

from tidemark.llm import hamming


def brute(rows, queries, k):
    out = set()
    for q, c in queries:
        near = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 10**9 + i for i, d in rows if i != q)
        out |= {(q, n + 1, x % 10**9, x // 10**9) for n, x in enumerate(near[:k])}
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, code long, distance string").repartition(4)


def check(spark, rows, queries, k, **options):
    got = {(r.query_id, r["rank"], r.id, r.distance) for r in hamming.top_k(table(spark, rows), table(spark, queries), k, **options).collect()}
    rows, queries = ([r for r in set(t) if None not in r] for t in (rows, queries))
    assert got == brute(rows, queries, k)


def test_clusters_copies_and_far_codes(spark):
    dice = random.Random(1)
    centres = [dice.getrandbits(64) for _ in range(5)]
    codes = [c ^ (1 << dice.randrange(64)) ^ (1 << dice.randrange(64)) for c in centres for _ in range(30)]
    codes += [centres[0]] * 40 + [dice.getrandbits(64) for _ in range(60)]
    rows = [(i, signed(c)) for i, c in enumerate(codes)]
    check(spark, rows, rows[::20], 7)


def test_few_rows_nulls_repeats_and_none(spark):
    rows = [(1, 0), (2, -1), (2, -1), (None, 5), (3, None), (4, 0)]
    check(spark, rows, rows, 10)
    assert hamming.top_k(table(spark, []), table(spark, rows)).count() == 0
    assert hamming.top_k(table(spark, rows), table(spark, [])).count() == 0


def test_sign_codes(spark):
    got = spark.createDataFrame([([1.0, -1.0, None, 2.0],), ([],), (None,)], "v array<float>").select(hamming.sign_code("v")).collect()
    assert [r[0] for r in got] == [9, 0, None]
    with pytest.raises(Exception, match="64 bits, not 65"):
        spark.createDataFrame([([1.0] * 65,)], "v array<float>").select(hamming.sign_code("v")).collect()


def test_cells_follow_the_number_of_codes(spark):
    assert [hamming.cell_bits(n) for n in (0, 4 << 20, (4 << 20) + 1, 1 << 40)] == [6, 6, 7, 14]
    dice = random.Random(3)
    rows = [(i, signed(dice.getrandbits(64))) for i in range(900)]
    check(spark, rows, rows[::60], 3, cell=8)  # 7 bits


def test_a_cell_that_holds_every_code(spark):
    """Codes that agree in all but a few bits of the last segment: three cells hold them all, in parts."""
    dice = random.Random(2)
    rows = [(i, dice.randrange(1 << 10)) for i in range(500)]
    check(spark, rows, rows[::50], 6, cell=20)
