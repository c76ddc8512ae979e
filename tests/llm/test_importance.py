import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tests.llm.rows import AWKWARD, docs
from tidemark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [("tok1 tok2 TOK3 unrelated words",), (None,), ("",), ("日本 語 one two",)]


def features(text, longest):
    words = WORD.findall((text or "").encode().lower().decode())
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least_words, longest, buckets):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = [0] * buckets, [0] * buckets
    for table, texts in ((raw, [t for _, t in rows]), (wanted, target)):
        for text in texts:
            for f in features(text, longest)[1]:
                table[place(f)] += 1
    gain = [math.floor(1000 * math.log((t + 1.0) * (sum(raw) + buckets) / ((s + 1.0) * (sum(wanted) + buckets)))) for s, t in zip(raw, wanted)]
    out = []
    for i, text in rows:
        words, found = features(text, longest)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-s, i is None, i or 0) for i, n, _, _, s in out if n >= least_words)
    return out, able[: len(able) * percent // 100]


@pytest.mark.parametrize("longest, least, percent, size", [(2, 20, 25, 1 << 22), (1, 1, 100, 1), (3, 4, 50, 300), (2, 10**9, 25, 300)])
def test_awkward_rows(spark, monkeypatch, longest, least, percent, size):
    monkeypatch.setattr(importance, "BATCH_BYTES", size)
    rows = docs(spark)
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    target = spark.createDataFrame(TARGET, "text string")
    got = importance.resample(rows, target, percent=percent, least_words=least, longest=longest, buckets=64).collect()
    want, drawn = brute(texts, [t for (t,) in TARGET], percent, least, longest, 64)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn


def test_no_run_crosses_two_texts():
    bucket, owner, words = importance.batch_features([b"a b", b"", b"c", b"\x00 ? ", "é f g".encode()], 3, 1 << 32, importance._Spaced())
    want = [(b"a", 0), (b"b", 0), (b"a b", 0), (b"c", 2), ("é".encode(), 4), (b"f", 4), (b"g", 4), ("é f".encode(), 4), (b"f g", 4), ("é f g".encode(), 4)]
    assert sorted(zip(bucket.tolist(), owner.tolist())) == sorted((zlib.crc32(f), o) for f, o in want)
    assert words.tolist() == [2, 0, 1, 0, 3]


def test_partitions_do_not_matter(spark):
    """Also with NULL and repeated ids of unlike texts: a text's hash decides between rows of one id."""
    texts = [(None if i % 2 else i % 10, f"tok{i} tok{i % 5} more words") for i in range(200)]
    target = spark.createDataFrame(TARGET, "text string")
    seen = set()
    for parts in (1, 3, 8):
        rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        got = importance.resample(rows, target, least_words=2)
        seen.add(tuple(sorted(map(tuple, got.where("rank IS NOT NULL").collect()), key=repr)))
    assert len(seen) == 1


def test_resampling_moves_toward_the_target(spark):
    """A third of the texts is like the target; a draw of a quarter would have 50 of them without weights."""
    rng = np.random.default_rng(1)
    pick = lambda words: " ".join(rng.choice(words, 40))
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    texts = [(i, pick(near if i % 3 == 0 else far)) for i in range(600)]
    target = spark.createDataFrame([(pick(near),) for _ in range(50)], "text string")
    got = importance.resample(spark.createDataFrame(texts, "doc_id long, text string"), target)
    drawn = [r["doc_id"] % 3 == 0 for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 150 and sum(drawn) > 100


def test_empty_tables(spark):
    target = spark.createDataFrame(TARGET, "text string")
    assert importance.resample(docs(spark, []), target).count() == 0
    got = importance.resample(docs(spark, AWKWARD), target.limit(0))
    assert got.count() == len(AWKWARD) and got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
