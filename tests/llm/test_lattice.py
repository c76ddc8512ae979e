import math
from collections import Counter

import numpy as np
import pytest

from tests.llm import rows
from tidemark.llm import lm
from tidemark.llm.lattice import CODE_POINTS, MARK, Lattice, Pieces

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "é"]


def brute(word, share, unknown):
    """Sum over all segmentations, by recursion on the rest of the marked word."""
    text = chr(MARK) + word

    def rest(at):
        if at == len(text):
            return 1.0
        total = sum(share[p] * rest(at + len(p)) for p in PIECES if text.startswith(p, at))
        return total + (0 if text[at] in PIECES else unknown / CODE_POINTS * rest(at + 1))

    return rest(0)


@pytest.fixture(scope="module")
def scores():
    share = np.append(np.arange(1, len(PIECES) + 1.0), 0.5)
    share /= share.sum()
    out = np.log(share)
    out[-1] -= math.log(CODE_POINTS)
    return dict(zip(PIECES, share, strict=False)), share[-1], out


def test_marginals_are_sums_over_all_segmentations(scores):
    share, unknown, logs = scores
    words = ["a", "ab", "abab", "xaby", "éa", "bbb", "aba" * 4, "日", "a"]
    got = np.exp(Lattice(words, Pieces.of(PIECES)).log_probabilities(logs))
    assert np.allclose(got, [brute(w, share, unknown) for w in words], rtol=1e-9, atol=0)


def test_expected_uses_are_slopes(scores):
    _, _, logs = scores
    words, counts = ["abab", "xa", "aba"], np.array([2.0, 1.0, 3.0])
    lattice = Lattice(words, Pieces.of(PIECES))
    uses = lattice.expected(logs, counts)
    for p in range(len(PIECES) + 1):
        up, down = logs.copy(), logs.copy()
        up[p] += 1e-5
        down[p] -= 1e-5
        slope = counts @ (lattice.log_probabilities(up) - lattice.log_probabilities(down)) / 2e-5
        assert abs(slope - uses[p]) < 1e-6


def test_a_mark_inside_a_word_and_a_very_long_word(scores):
    _, _, logs = scores
    got = Lattice(["a▁a", "a" * 20_000], Pieces.of(PIECES)).log_probabilities(logs)
    assert np.isfinite(got).all() and got[1] < -1000


def base_scores(table):
    import zlib

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in table]
    train = Counter(w for (_, t), h in zip(table, held, strict=True) if not h for w in rows.words(t))
    ends = held.count(False)
    n, v = sum(train.values()) + ends, len(train) + (ends > 0)
    for (i, text), h in zip(table, held, strict=True):
        seen = [train[w] for w in rows.words(text)] + [ends]
        yield i, h, len(seen), sum(c > 0 for c in seen), n, round(sum(math.log10((c + 1) / (n + v + 1)) for c in seen), 6)


@pytest.mark.parametrize("top", [lm.TOP, 3])
def test_base_scores_of_awkward_rows(spark, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    table = [(100 + k if i is None and t else i, t) for k, (i, t) in enumerate(rows.AWKWARD)]
    out = lm.score_documents(rows.docs(spark, table), rounds=1).collect()
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == sorted((i or -1, *x) for i, *x in base_scores(table))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_probabilities_of_all_short_words_stay_below_one(spark):
    table = [(i, "a b ab a c") for i in range(20)]
    letters = "abcd"
    probes = [x for x in letters] + [x + y for x in letters for y in letters]
    # every one-word text over four letters; held-out ids are found so that they are not learned from
    import zlib

    free = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(probes) + 1]
    docs = rows.docs(spark, table + list(zip(free, [*probes, ""], strict=True)))
    out = {r.doc_id: r.score for r in lm.score_documents(docs, rounds=1).collect()}
    assert 0 < sum(10 ** out[i] for i in free) < 1


def test_better_than_counts_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = lm.score_documents(docs).where("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert held.a > held.b


def test_empty_table(spark):
    assert lm.score_documents(rows.docs(spark, []), rounds=1).count() == 0


def whole_scores(table, most):
    """Both scores of each row (id, text, lang), told from the model's definition with the first piece scores."""
    import zlib

    first = np.exp(lm.first_scores(len(PIECES)))
    spell = lambda w: brute(w.decode(), dict(zip(PIECES, first)), first[-1] * CODE_POINTS)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in table]
    langs = Counter(lang for (_, _, lang), h in zip(table, held) if not h and lang is not None)
    names = sorted(langs, key=lambda x: (-langs[x], x))[:most]
    place = lambda lang: names.index(lang) if lang in names else len(names)
    k = len(names) + 1
    counts, docs = [Counter() for _ in range(k)], np.zeros(k)
    for (_, text, lang), h in zip(table, held):
        if not h:
            counts[place(lang)].update(rows.words(text))
            docs[place(lang)] += 1
    tokens = np.array([sum(c.values()) for c in counts], float)
    discount = lambda c: 0.0 if c == 0 else lm.DISCOUNTS[min(c, 3) - 1]
    mass = np.array([sum(discount(n) for n in c.values()) for c in counts])
    back = [m / t if t else 1.0 for m, t in zip(mass, tokens)]
    end, share = (docs + 1) / (tokens + docs + 2), (docs + 1) / (docs.sum() + k)
    e = (docs.sum() + 1) / (tokens.sum() + docs.sum() + 2)
    for i, text, _ in table:
        words, total = rows.words(text), 0.0
        for c in range(k):
            p = share[c] * end[c]
            for w in words:
                n = counts[c][w]
                p *= (1 - end[c]) * ((n - discount(n)) / max(tokens[c], 1) + back[c] * spell(w))
            total += p
        plain = e * math.prod((1 - e) * spell(w) for w in words)
        yield i, text, round(math.log10(total), 4), round(math.log10(plain), 4)


@pytest.mark.parametrize("most, top", [(1, 2), (None, lm.TOP)])
def test_scores_are_those_of_the_model_as_told(spark, monkeypatch, most, top):
    monkeypatch.setattr(lm, "TOP", top)
    monkeypatch.setattr(lm, "read_pieces", lambda path: PIECES)
    texts = ["ab a ab", "A b", "", None, "x ab ab ab", "éa bb a", "a", "ba ba ab", "日 a", "b b b b"]
    langs = ["en", "de", None, "en", "fr", "de", "xx"]
    table = [(None if k == 11 else k, texts[k % len(texts)], langs[k % len(langs)]) for k in range(24)]
    docs = spark.createDataFrame([(*r, 5) for r in table], "doc_id long, text string, lang string, _class int").repartition(3)
    got = lm.score_documents(docs, rounds=0, most_classes=most).select("doc_id", "score", "lattice_score").collect()
    want = [(i, a, b) for i, _, a, b in whole_scores(table, most)]
    assert sorted(((r.doc_id, round(r.score, 4), round(r.lattice_score, 4)) for r in got), key=repr) == sorted(want, key=repr)


def test_classes_come_from_training_rows(spark):
    import zlib

    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == 2][:30]
    rows_ = [(i, "a b", "rare") for i in held] + [(1000 + k, "a b", "en") for k in range(20) if zlib.crc32(str(1000 + k).encode()) % 7 != 2]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string").withColumn("_held", lm.remainder(lm.F.col("doc_id"), 7) == 2)
    placed, n = lm._class_of(docs, "lang", None)
    assert n == 2 and {(r.lang, r._class) for r in placed.collect()} == {("en", 0), ("rare", 1)}
