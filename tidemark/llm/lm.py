"""Scoring of documents by subword lattices.

The vocabulary is that of an existing tokenizer file; its pieces weight all segmentations of a word (:mod:`lattice`). The
order of the file gives the first scores, and a few rounds of expectation maximisation over the corpus' distinct words fit
them, for each text class on its own. A word of the training part also has one arc of its own, over its whole length,
with its discounted count; what is discounted goes to the pieces. A document's probability is the sum over classes of
the class' share times the product over its words, then the end, so nothing of a text but its words is used. Classes come
from a column of the training documents (its most frequent values and the rest); without it there is one.

How it runs: words are counted by class in a pass over the texts (merged within each task first); each fitting round is
a pass over the distinct words that brings back one number per piece and class; a second pass over the texts adds up the
``TOP`` most frequent words, whose values are broadcast (a bound, not a share), and the other words, which no document
set repeats often, are joined by hash. So no word is hot in any shuffle, and nothing grows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashed import remainder
from tidemark.llm.lattice import CODE_POINTS, MARK, Lattice, Pieces
from tidemark.llm.text import WordHashes, spaced_words
from tidemark.runtime import stage, working

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TOP = 131_072  # words whose values every task holds: 4 to 8 MB
CLASSES = 6  # by default the most frequent values of the class column among the training rows, and one for the rest
ROUNDS = 3
DISCOUNTS = (0.6, 1.2, 1.6)  # of words counted once, twice, more often
FLUSH = 400_000  # distinct words a task holds before it hands them on
WORDS = 20_000  # words to a lattice


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that lower-cased words without white space can contain, in the file's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    return [t for t in texts if not any("A" <= c <= "Z" for c in t) and chr(MARK) not in t[1:]]


def first_scores(n: int) -> np.ndarray:
    """Log probabilities by rank, and for an unknown character: what the file's order says before any fitting."""
    share = np.append(1 / (np.arange(n) + 10.0), 1e-3)
    return _logs(share / share.sum())


def _logs(shares: np.ndarray) -> np.ndarray:
    out = np.log(shares)
    out[-1] -= np.log(CODE_POINTS)
    return out


@dataclass(frozen=True)
class Counts:
    """Per class: word tokens, discounted mass, documents. ``n`` and ``v``: training tokens and distinct ones, ends included."""

    tokens: np.ndarray
    mass: np.ndarray
    docs: np.ndarray
    n: int
    v: int


def _class_of(docs: DataFrame, column: str, most: int | None) -> tuple[DataFrame, int]:
    """Adds ``_class``: the place of the row's value among those of the training rows (``_held`` is false); the rest last."""
    if column not in docs.columns:
        return docs.withColumn("_class", F.lit(0)), 1
    value = F.col(column).cast("string")
    top = docs.where(~F.col("_held") & value.isNotNull()).groupBy(value.alias("value")).count().orderBy(F.desc("count"), "value")
    names = [r[0] for r in (top if most is None else top.limit(most)).collect()]
    known = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    place = F.coalesce(F.array_position(known, value), F.lit(0)).cast("int")
    return docs.withColumn("_class", F.when(place > 0, place - 1).otherwise(len(names))), len(names) + 1


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """``word, hash, counts`` (training tokens by class) of every distinct word; ``docs``: text, _class, _held."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict[bytes, int]] = [{} for _ in range(classes + 1)]  # the last: words of held-out texts

        def flushed() -> pa.RecordBatch:
            words = [w for d in seen for w in d]
            kinds = np.repeat(np.arange(classes + 1), [len(d) for d in seen])
            counts = [c for d in seen for c in d.values()]
            for d in seen:
                d.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array(kinds, pa.int32()), pa.array(counts, pa.int64())], names=["word", "kind", "n"]
            )

        for batch in batches:
            for text, kind, held in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                into = seen[classes if held else kind]
                for w in spaced_words(text.as_py()):
                    into[w] = into.get(w, 0) + 1
                if sum(map(len, seen)) > FLUSH:
                    yield flushed()
        yield flushed()

    rows = docs.select("text", "_class", "_held").mapInArrow(counted, "word string, kind int, n long")
    by_class = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    out = rows.groupBy("word").agg(*by_class)
    return out.select("word", F.array(*[f"c{k}" for k in range(classes)]).alias("counts"))


def _counts_of(batch: pa.RecordBatch, place: int) -> np.ndarray:
    column = batch.column(place)
    return column.flatten().to_numpy().reshape(len(column), -1)


def _discounts(counts: np.ndarray) -> np.ndarray:
    return np.select([counts == 0, counts == 1, counts == 2], [0.0, *DISCOUNTS[:2]], DISCOUNTS[2])


def fit_pieces(vocabulary: DataFrame, pieces, classes: int, n: int, rounds: int) -> np.ndarray:
    """Scores by class: each round takes every distinct training word once and brings back expected uses by piece."""
    scores = np.tile(first_scores(n), (classes, 1))
    spark = vocabulary.sparkSession
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(scores)

        def uses(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((classes, n + 1))
            for batch in batches:
                words, known = batch.column(0).to_pylist(), _counts_of(batch, 1) > 0
                for a in range(0, len(words), WORDS):
                    lattice = Lattice(words[a : a + WORDS], Pieces(*pieces.value))
                    for k in range(classes):
                        total[k] += lattice.expected(now.value[k], known[a : a + WORDS, k].astype(float))
            kind, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[kind, piece], pa.float64())], names=["kind", "piece", "uses"]
            )

        got = vocabulary.where(F.exists("counts", lambda c: c > 0)).select("word", "counts")
        got = got.mapInArrow(uses, "kind int, piece int, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.full((classes, n + 1), 0.1)
        total[got["kind"].to_numpy(), got["piece"].to_numpy()] += got["uses"].to_numpy()
        some = total.sum(axis=1) > 0.1 * (n + 1) + 1e-9  # a class without words keeps the first scores
        scores = np.where(some[:, None], [_logs(t / t.sum()) for t in total], scores)
        now.unpersist()
    return scores


def word_values(vocabulary: DataFrame, pieces, scores, totals: Counts) -> DataFrame:
    """``hash, c, logs``: training count and log probability of each word by class (without the class' share and end), and
    last by the pieces' first scores alone."""
    share = np.where(totals.tokens > 0, totals.mass / np.maximum(totals.tokens, 1), 1.0)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), _counts_of(batch, 1)
            own = (counts - _discounts(counts)) / np.maximum(totals.tokens, 1)
            logs = []
            for a in range(0, len(words), WORDS):
                lattice = Lattice(words[a : a + WORDS], Pieces(*pieces.value))
                spelled = np.stack([lattice.log_probabilities(s) for s in scores.value], axis=1)
                given = lattice.log_probabilities(first_scores(lattice.n))
                with np.errstate(divide="ignore"):
                    by_class = np.logaddexp(np.log(own[a : a + WORDS]), np.log(share) + spelled)
                logs.append(np.column_stack([by_class, given]))
            flat = np.concatenate(logs).astype(np.float32) if logs else np.empty((0, len(share) + 1), np.float32)
            ends = np.arange(len(flat) + 1, dtype=np.int32) * (len(share) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.of([w.encode() for w in words]).view(np.int64)),
                    pa.array(counts.sum(axis=1)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel())),
                ],
                names=["hash", "c", "logs"],
            )

    return vocabulary.select("word", "counts").mapInArrow(valued, "hash long, c long, logs array<float>")


def score_documents(
    docs: DataFrame,
    folds: int = 7,
    held_out: int = 2,
    vocabulary: str = VOCABULARY,
    class_column: str = "lang",
    rounds: int = ROUNDS,
    most_classes: int | None = CLASSES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score`` of every row, in log10.

    ``score`` is the fitted model's, ``lattice_score`` the product of the words' lattice marginals under the vocabulary's
    first scores and of the end. ``most_classes``: how many values of the class column have a class of their own, the most
    frequent among training rows (None: all of them); the others share one.

    Tokens are the white-space separated words, A to Z lower-cased, then one end. Rows whose CRC-32 of the id as text
    leaves ``held_out`` modulo ``folds`` are not learned from; a NULL id is learned from. ``base_score`` sums
    ``log10((c + 1) / (N + V + 1))``. A NULL text is empty: only its end is scored. Rows are scored one by one, so
    repeated ids give repeated rows. Without training rows the pieces' first scores decide. Words are matched by
    64-bit hash.
    """
    with working() as keep:
        held = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
        kept = [c for c in ("doc_id", "text", class_column) if c in docs.columns]
        docs, classes = _class_of(docs.select(*dict.fromkeys(kept), held.alias("_held")), class_column, most_classes)
        docs = docs.select("doc_id", "text", "_class", "_held")
        words = stage(count_words(docs, classes), "lm-words")
        discounted = lambda k: F.when(F.col("counts")[k] == 0, 0.0).when(F.col("counts")[k] == 1, DISCOUNTS[0]).when(F.col("counts")[k] == 2, DISCOUNTS[1]).otherwise(DISCOUNTS[2])
        sums = words.agg(
            *[F.sum(F.col("counts")[k]) for k in range(classes)],
            *[F.sum(discounted(k)) for k in range(classes)],
            F.count_if(F.exists("counts", lambda c: c > 0)),
        ).first()
        ends = np.zeros(classes)
        for r in docs.where(~F.col("_held")).groupBy("_class").count().collect():  # a row per class
            ends[r["_class"]] = r["count"]
        tokens, mass = (np.array([x or 0 for x in sums[a : a + classes]], float) for a in (0, classes))
        totals = Counts(tokens, mass, ends, int(tokens.sum() + ends.sum()), int((sums[-1] or 0) + (ends.sum() > 0)))
        spark = docs.sparkSession.sparkContext
        texts = read_pieces(vocabulary)
        pieces = spark.broadcast(Pieces.of(texts).plain())
        scores = fit_pieces(words, pieces, classes, len(texts), rounds)
        values = stage(word_values(words, pieces, spark.broadcast(scores), totals), "lm-values")
        return keep(stage(_added_up(docs, values, totals), "lm-scores"))


def _frequent(values: DataFrame) -> int:
    """The least count that no more than ``TOP`` words reach, from a histogram with eight steps to each doubling."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = values.where("c > 0").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred rows
    words, least = 0, None
    for r in sizes:
        words += r["count"]
        if words > TOP:
            break
        least = r["step"]
    return 2**62 if least is None else int(np.ceil(2 ** (least / 8) - 1e-9))


def _added_up(docs: DataFrame, values: DataFrame, totals: Counts) -> DataFrame:
    spark, classes = docs.sparkSession.sparkContext, len(totals.docs)
    top = values.where(F.col("c") >= _frequent(values)).select("hash", "c", "logs").toArrow()  # at most TOP rows
    order = np.argsort(top["hash"].to_numpy().view(np.uint64))
    hashes, c = top["hash"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order]
    logs = top["logs"].combine_chunks().flatten().to_numpy().reshape(-1, classes + 1)[order]
    held_values = spark.broadcast((hashes, c, logs))
    shift = np.log10(totals.n + totals.v + 1)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        keys, c, logs = held_values.value
        base_of = np.log10(c + 1) - shift
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = []
                for text in batch.column(1).slice(first, 1000):
                    found, counts = np.unique(seen.of(spaced_words(text.as_py())), return_counts=True)
                    at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
                    hot = keys[at] == found if len(keys) else np.zeros(len(found), bool)
                    at, n = at[hot], counts[hot]
                    rows.append((int(counts.sum()), int(n.sum()), float(n @ base_of[at]), (n @ logs[at]).astype(float), found[~hot], counts[~hot]))
                ends = np.cumsum([0, *[len(r[4]) for r in rows]]).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows]).astype(kind)))
                    for k, kind in ((4, np.uint64), (5, np.int32))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, 1000),
                        batch.column(2).slice(first, 1000),
                        *[pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))],
                        pa.array([r[3].tolist() for r in rows], pa.list_(pa.float64())),
                        lists[0].cast(pa.list_(pa.int64()), safe=False),
                        lists[1],
                    ],
                    names=["doc_id", "held_out", "n", "known", "base", "sums", "hashes", "counts"],
                )

    kind = "doc_id long, held_out boolean, n long, known long, base double, sums array<double>, hashes array<long>, counts array<int>"
    read = docs.select(F.col("doc_id").cast("long"), "text", "_held").mapInArrow(added, kind)
    read = stage(read.withColumn("_doc", F.monotonically_increasing_id()), "lm-docs")
    rare = read.select("_doc", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("counts").alias("tf")))).join(values, "hash")
    rare = rare.groupBy("_doc").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("_known"),
        F.sum(F.col("tf") * (F.log10(F.col("c") + 1.0) - float(shift))).alias("_base"),
        *[F.sum(F.col("tf") * F.col("logs")[k].cast("double")).alias(f"_s{k}") for k in range(classes + 1)],
    )
    end = (totals.docs + 1) / (totals.tokens + totals.docs + 2)
    share = (totals.docs + 1) / (totals.docs.sum() + classes)
    every = F.col("n").cast("double")
    by_class = [
        F.lit(float(np.log(share[k]) + np.log(end[k]))) + every * float(np.log1p(-end[k])) + F.col("sums")[k] + F.coalesce(f"_s{k}", F.lit(0.0))
        for k in range(classes)
    ]
    e = float((totals.docs.sum() + 1) / (totals.tokens.sum() + totals.docs.sum() + 2))
    given = float(np.log(e)) + every * float(np.log1p(-e)) + F.col("sums")[classes] + F.coalesce(f"_s{classes}", F.lit(0.0))
    most = F.greatest(*by_class) if classes > 1 else by_class[0]
    of_end = float(np.log10(totals.docs.sum() + 1) - shift)
    total = F.lit(0.0)
    for k in range(classes):
        total = total + F.exp(F.col(f"_p{k}") - F.col("_most"))
    joined = read.join(rare, "_doc", "left").withColumns({f"_p{k}": p for k, p in enumerate(by_class)} | {"_most": most})
    return joined.select(
        "doc_id",
        "held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("_known", F.lit(0)) + int(totals.docs.sum() > 0)).cast("long").alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) + of_end).alias("base_score"),
        ((F.col("_most") + F.log(total)) / float(np.log(10))).alias("score"),
        (given / float(np.log(10))).alias("lattice_score"),
    )
