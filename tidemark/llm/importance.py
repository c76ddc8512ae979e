"""Importance resampling toward a target distribution, over hashed n-grams of words.

Documents and target texts are bags of word runs dealt into buckets by CRC-32. A bucket's gain is the logarithm of how much
more often target texts fill it than documents do; a document's weight is the mean gain of its features, and Gumbel noise
from its id turns the highest scores into a weighted draw without replacement.

Texts are read in batches: a batch is joined into one byte string with a sentinel after each text, a byte that UTF-8 never
has, so that one pass of a pattern finds all words and all ends. A run of words lies in one text if the next sentinel, which
``searchsorted`` finds, comes after its last word; runs that cross one are masked, and ``bincount`` adds up the rest.

The texts are read twice: for the counts, of which each task sends one row per bucket, and for the weights. The draw takes
a position in a distributed order, not a sort in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.order import ordered, with_position
from tidemark.runtime import staging

BUCKETS, LONGEST = 10_000, 2
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
BATCH_BYTES = 4 << 20  # of texts joined at a time, unless one text alone is longer

END = b"\xff"  # in no UTF-8 text
_TOKENS = re.compile(rb"[0-9a-z\x80-\xf4]+|\xff")


class _Spaced(dict):
    """Words with a space before them, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = b" " + word
        return value


def batch_features(texts: list[bytes], longest: int, buckets: int, spaced: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words, the text each lies in, and the number of words of each text."""
    tokens = _TOKENS.findall(END.join([*texts, b""]))
    ends = np.flatnonzero(np.fromiter(map(END.__eq__, tokens), bool, len(tokens)))
    at = np.arange(len(tokens))
    owner = np.searchsorted(ends, at)  # the sentinel belongs to the text it ends
    room = ends[owner] - at  # words from here to the end of the text
    crcs, after = list(map(zlib.crc32, tokens)), list(map(spaced.__getitem__, tokens))
    found, owners = [], []
    for n in range(1, longest + 1):
        inside = room[: len(crcs)] >= n
        found.append(np.array(crcs, np.int64)[inside] % buckets)
        owners.append(owner[: len(crcs)][inside])
        crcs = list(map(zlib.crc32, after[n:], crcs))
    return np.concatenate(found), np.concatenate(owners), np.diff(ends, prepend=-1) - 1


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of runs of at most ``BATCH_BYTES`` bytes, or one text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode().lower()
        if held and size + len(raw) > BATCH_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket; ``buckets`` numbers reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, total = _Spaced(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                total += np.bincount(batch_features(part, longest, buckets, spaced)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over raw share, one added to every bucket, rounded down."""
    n = len(raw)
    return np.floor(1000 * np.log((target + 1.0) * (raw.sum() + float(n)) / ((raw + 1.0) * (target.sum() + float(n))))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, digest, n_words, n_features, weight`` of every row: the mean gain of its features, rounded down (none: 0)."""
    table, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, gain = _Spaced(), table.value.astype(np.float64)
        for batch in batches:
            for first, part in _slices(batch.column(2)):
                found, owner, words = batch_features(part, longest, buckets, spaced)
                n = np.bincount(owner, minlength=len(part))
                total = np.bincount(owner, gain[found], len(part)).astype(np.int64)  # exact: below 2 ** 53
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        batch.column(1).slice(first, len(part)),
                        *[pa.array(x.astype(np.int64)) for x in (words, n, total // np.maximum(n, 1))],
                    ],
                    names=["doc_id", "digest", "n_words", "n_features", "weight"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), F.col("text").cast("string"))
    return read.mapInArrow(weigh, "doc_id long, digest long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Every row's ``doc_id, n_words, n_features, weight, score, rank``; ``rank`` is NULL for rows that are not drawn.

    Of the N rows with at least ``least_words`` words the ``percent * N // 100`` highest scores are drawn, equal ones by
    ascending id (NULL last), then by a hash of the text; rows equal in both are interchangeable. A NULL or wordless text
    has no features and weight 0. Noise comes from the id alone, so repeated ids share it, and all NULL ids do. Other
    columns are ignored; no rows give no rows, and no target texts a target of equal shares.
    """
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    with staging() as keep:
        rows = weighed(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        rows = keep(rows.withColumn("_doc", F.monotonically_increasing_id()), "resample-rows")
        short = F.col("n_words") < least_words
        drawn = rows.where(~short).count() * percent // 100
        order = [short, F.desc("score"), F.asc_nulls_last("doc_id"), "digest", "_doc"]
        placed = with_position(ordered(rows, order, "resample-order"))
        rank = F.when(F.col("position") < drawn, F.col("position") + 1)
        return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))
