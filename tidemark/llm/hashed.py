"""Texts as sparse rows of hashed features, for the numpy classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from tidemark.llm.text import WordHashes, alphanumeric_words

_KINDS = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)


def shapes(text: str) -> list[bytes]:
    """Each white-space separated token with letters, capitals and digits as one mark each and runs as one character."""
    kinds = np.frombuffer(text.encode().translate(_KINDS), np.uint8)
    return kinds[np.append(True, kinds[1:] != kinds[:-1])].tobytes().split() if len(kinds) else []


class Featurizer:
    """Rows of ``2 ** bits`` features: words and, on request, token shapes, as ``1 + log(count)``, scaled to length 1."""

    def __init__(self, bits: int, with_shapes: bool = False):
        self.bits, self.with_shapes = bits, with_shapes
        self.seen, self.seen_shapes = WordHashes(), WordHashes()

    def _scaled(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots, counts = np.unique(hashes >> np.uint64(64 - self.bits), return_counts=True)
        values = 1 + np.log(counts)
        return slots.astype(np.int64), values / np.sqrt((values**2).sum()) if len(slots) else values

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values); no slots for a NULL, empty or wordless text."""
        text = text or ""
        parts = [self._scaled(self.seen.of(alphanumeric_words(text)))]
        if self.with_shapes:
            parts.append(self._scaled(~self.seen_shapes.of(shapes(text))))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Rows:
    """Sparse rows in one array, with the two products a linear model needs."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray], width: int):
        self.width, self.n = width, len(slots)
        self.slots = np.concatenate([*slots, np.empty(0, np.int64)])
        self.values = np.concatenate([*values, np.empty(0)])
        self.owner = np.repeat(np.arange(self.n), [len(s) for s in slots])

    def only(self, features: np.ndarray) -> Rows:
        """The same rows with these features alone, renumbered in their order."""
        place = np.full(self.width, -1)
        place[features] = np.arange(len(features))
        out = Rows([], [], len(features))
        kept = place[self.slots] >= 0
        out.n, out.slots, out.values, out.owner = self.n, place[self.slots[kept]], self.values[kept], self.owner[kept]
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * weights[self.slots], self.n)

    def back(self, each: np.ndarray) -> np.ndarray:
        """Sum of rows, each times its number."""
        return np.bincount(self.slots, self.values * each[self.owner], self.width)


class Adam:
    """Plain Adam steps on a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def step(self, slopes: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, slopes, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def remainder(doc_id: Column, of: int) -> Column:
    """CRC-32 of the id as text, modulo ``of``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % of


def bounded_sample(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose ``doc_id`` hashes lowest: the same rows whatever the partitioning.

    Rows that hash too high to be among them are dropped where they lie, so no task gets ``limit`` rows from each other.
    """
    share = min(1.0, (1.2 * limit + 1000) / max(ids.count(), 1))
    low = ids.where(F.xxhash64("doc_id") <= int(-(2**63) + share * (2**64 - 2**11)))
    return low.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def collect_rows(docs: DataFrame, wanted: DataFrame, bits: int, with_shapes: bool) -> dict:
    """Features of the documents in ``wanted`` (``doc_id`` and one more column; bounded) as numpy rows on the driver.

    One row per id: of rows that repeat it, the one whose text has the smallest SHA-256 (NULL first), so the bound on ids
    bounds the rows. Rows that are equal in features and mark count once, so copies of a text do not outweigh it.
    """
    mark = next(c for c in wanted.columns if c != "doc_id")

    def featurized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Featurizer(bits, with_shapes)
        for batch in batches:
            rows = [maker.row(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s.astype(np.int32).tobytes() for s, _ in rows], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary()),
                ],
                names=["mark", "slots", "values"],
            )

    sample = docs.select("doc_id", "text").join(F.broadcast(wanted.withColumnRenamed(mark, "mark")), "doc_id")
    digest = F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit(""))
    sample = sample.groupBy("doc_id").agg(F.first("mark").cast("long").alias("mark"), F.min_by("text", digest).alias("text"))
    sample = sample.select("mark", "text")
    got = sample.mapInArrow(featurized, "mark long, slots binary, values binary").toArrow()
    rows = sorted(set(zip(*(got[c].to_pylist() for c in ("mark", "slots", "values")), strict=True)))
    return {
        "marks": np.array([m for m, _, _ in rows], np.int64),
        "slots": [np.frombuffer(s, np.int32).astype(np.int64) for _, s, _ in rows],
        "values": [np.frombuffer(v, np.float32).astype(np.float64) for _, _, v in rows],
    }


def scorer(bits: int, with_shapes: bool, weights, finish: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """A pandas UDF of the text: ``finish`` of the row's product with the broadcast ``weights``."""

    def score(batches):
        maker, w = Featurizer(bits, with_shapes), weights.value
        for texts in batches:
            sums = np.array([float(v @ w[s]) for s, v in map(maker.row, texts)])
            yield pd.Series(finish(sums) if len(sums) else sums)

    return F.pandas_udf(score, "double", PandasUDFType.SCALAR_ITER)
