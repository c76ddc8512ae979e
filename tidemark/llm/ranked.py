"""Ranked lexical search: the highest-scoring documents for each of a set of texts, with copies scored once.

1. The items' distinct terms are the vocabulary. One pass over the documents counts all terms of each and keeps, of those
   in the vocabulary, the bag: term numbers and how often each occurs, with a hash of both.
2. Rows with equal bags and equal length class ``m`` have equal scores for every item. They are dealt by the hash, told
   apart by the bags themselves, and become one class, of which the ``k`` smallest ids are kept: no item can list more.
3. Each class is scored once against all items, a block of items at a time, in whole numbers. A task passes on at most ``k``
   classes an item, so what is shuffled is bounded by tasks, items and ``k``, however common a word is.
4. An item's ``k`` best classes, by score and smallest id, hold its ``k`` best documents: any other class has ``k`` classes
   before it, each with a document that comes first. They are expanded into their members by ascending id.

Items are taken in blocks of at most ``BLOCK`` terms (or one longer item), which bounds what is broadcast. Each further block
reads the documents once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.order import ordered, with_running
from tidemark.llm.text import alphanumeric_words
from tidemark.runtime import stage, staging

BEST = 20
BLOCK = 1 << 19  # terms of the items that are broadcast at a time, repeats included
CELLS = 1 << 21  # scores held at a time in a task
EXACT = 2**53  # whole numbers below it are exact as doubles


def item_terms(items: DataFrame) -> DataFrame:
    """``_item, item_id, terms, n_terms`` of the rows that have terms; ``_item`` numbers the rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[w.decode() for w in alphanumeric_words(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    read = items.select("item_id", F.col("text").cast("string")).mapInArrow(split, f"item_id {kind}, terms array<string>")
    read = read.withColumns({"_item": F.monotonically_increasing_id(), "n_terms": F.size("terms").cast("long")})
    return read.where("n_terms > 0")


class Index:
    """A block of items as postings: for each term number, the items that have it and how often. Plain arrays inside."""

    def __init__(self, terms: list[list[str]]):
        words = sorted({t for each in terms for t in each})
        self.vocabulary = {w.encode(): i for i, w in enumerate(words)}
        owner = np.repeat(np.arange(len(terms)), list(map(len, terms)))
        number = np.array([self.vocabulary[t.encode()] for each in terms for t in each], np.int64)
        pairs, self.times = np.unique(number * len(terms) + owner, return_counts=True)
        self.items = pairs % len(terms)
        self.starts = np.searchsorted(pairs // len(terms), np.arange(len(words) + 1))


def bags(docs: DataFrame, vocabulary: dict[bytes, int], bits: int = 64) -> DataFrame:
    """``doc_id, n, key, terms, tfs``: number of all terms; numbers and counts of those in the vocabulary; hash of both."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    mask = (1 << bits) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                counts, rows = [], []
                for text in batch.column(1).slice(first, 1000):
                    words = alphanumeric_words(text.as_py())
                    counts.append(len(words))
                    ids, tfs = np.unique(np.array([i for i in map(number, words) if i is not None], np.int32), return_counts=True)
                    rows.append((ids.tobytes(), tfs.astype(np.int32).tobytes()))
                keys = np.array([xxhash.xxh3_64_intdigest(a + b) & mask for a, b in rows], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, 1000), pa.array(counts, pa.int64()), pa.array(keys)]
                    + [pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)],
                    names=["doc_id", "n", "key", "terms", "tfs"],
                )

    read_docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read_docs.mapInArrow(read, "doc_id long, n long, key long, terms binary, tfs binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int32).astype(np.int64), np.array([len(r) // 4 for r in rows], np.int64)


def document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many rows hold each term; a row per term and task is shuffled, ``n_terms`` numbers reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0))[0], minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    got = rows.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[got["term"].to_numpy()] = got["df"].to_numpy()
    return out


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """``class, m, terms, tfs, doc_id, place`` of the first ``k`` members of each class; the bag only beside the first one."""
    same = W.partitionBy("key", "m", "terms", "tfs").orderBy(F.asc_nulls_last("doc_id"), "_doc")
    first = F.first("_doc").over(same.rowsBetween(W.unboundedPreceding, 0))
    few = rows.withColumns({"place": F.row_number().over(same), "class": first}).where(F.col("place") <= k)
    bag = [F.when(F.col("place") == 1, F.col(c)).alias(c) for c in ("terms", "tfs")]
    return few.select("class", "m", *bag, "doc_id", "place")


class _Best:
    """The ``k`` best of each item so far: highest score, then smallest id (NULL last), then smallest class."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.held = [np.empty(0, np.int64) for _ in range(5)]
        self.new: list[list[np.ndarray]] = []
        self.waiting, self.room = 0, max(1 << 16, 2 * k * n_items)

    def add(self, item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc: np.ndarray, cls: np.ndarray) -> None:
        self.new.append([item, score, missing, doc, cls])
        self.waiting += len(item)
        if self.waiting > self.room:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        if self.new:
            item, score, missing, doc, cls = (np.concatenate(c) for c in zip(self.held, *self.new, strict=True))
            order = np.lexsort((cls, doc, missing, -score, item))
            sorted_ = item[order]
            place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
            order = order[place < self.k]
            self.held = [c[order] for c in (item, score, missing, doc, cls)]
            last = place[place < self.k] == self.k - 1
            self.least[self.held[0][last]] = self.held[1][last]
            self.new, self.waiting = [], 0
        return self.held


def class_scores(classes: DataFrame, index: Index, n_items: int, weights: np.ndarray, k: int) -> DataFrame:
    """``item, score, class, doc_id`` of at most ``k`` classes an item and task; ``item`` is the place in the block."""
    heaviest = np.bincount(index.items, (index.times * np.repeat(weights, np.diff(index.starts))).astype(float), n_items).max()
    exact = heaviest * 1e6 < EXACT  # a term adds less than its weight times a million
    sent = classes.sparkSession.sparkContext.broadcast((index.starts, index.items, index.times, weights))

    def chunk_scores(m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        starts, items, times, weight = sent.value
        owner = np.repeat(np.arange(len(m)), lengths)
        each = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[owner]))
        n = starts[terms + 1] - starts[terms]
        at = np.repeat(starts[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell, gain = np.repeat(owner, n) * n_items + items[at], np.repeat(each, n) * times[at]
        if exact:
            return np.bincount(cell, gain, len(m) * n_items).astype(np.int64).reshape(-1, n_items)
        out = np.zeros(len(m) * n_items, np.int64)
        np.add.at(out, cell, gain)
        return out.reshape(-1, n_items)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = _Best(n_items, k), max(1, CELLS // n_items)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                cls, m = (part.column(i).to_numpy() for i in (0, 1))
                missing = part.column(4).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = part.column(4).fill_null(0).to_numpy()
                terms, lengths = _numbers(part.column(2))
                found = chunk_scores(m, terms, _numbers(part.column(3))[0], lengths)
                row, item = np.nonzero(found >= best.least)
                best.add(item, found[row, item], missing[row], doc[row], cls[row])
        item, points, missing, doc, cls = best.settle()
        doc = pa.array(doc, mask=missing.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(points), pa.array(cls), doc], names=["item", "score", "class", "doc_id"])

    firsts = classes.where((F.col("place") == 1) & (F.octet_length("terms") > 0))
    return firsts.select("class", "m", "terms", "tfs", "doc_id").mapInArrow(score, "item long, score long, class long, doc_id long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """``_item, item_id, rank, doc_id, score, class`` of the ``k`` highest-scoring rows of ``docs`` for each row of ``items``.

    Terms are runs of letters, digits and non-ASCII characters, A to Z lower-cased, of whole texts. With N the rows that
    have terms, L all their terms, n a row's own, df the rows that hold a term and tf its count in the row, a term's weight
    is ``floor(1000 ln((2 N + 2) / (2 df + 1)))``, m is ``75 + 25 n N div L`` and the score is the sum over the item's terms,
    repeats included, of ``weight * (10**9 tf div (1000 tf + 12 m))``. Scores above 0 count; equal scores go by ascending
    ``doc_id``, NULL ids last, rows equal in both in any order. Every row is a document and every row of ``items`` an item,
    whatever their ids, so repeated rows are listed each; ``_item`` tells items of one id apart. Texts without terms,
    NULL ones included, are never listed and list nothing; empty tables give no rows. ``bits``: of the hash of a bag, whose
    collisions cost time and not results. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    with staging() as keep:
        listed = keep(item_terms(items), "rank-items")
        running = with_running(ordered(listed, ["_item"], "rank-order"), "n_terms")
        placed = keep(running.withColumn("_block", F.floor((F.col("upto") - F.col("n_terms")) / block)), "rank-blocks")
        for (number,) in placed.select("_block").distinct().orderBy("_block").collect():  # one per BLOCK terms
            part = placed.where(F.col("_block") == number).select("_item", "terms").orderBy("_item").toArrow()
            own, index = part["_item"].to_numpy(), Index(part["terms"].to_pylist())
            rows = bags(docs, index.vocabulary, bits).withColumn("_doc", F.monotonically_increasing_id())
            rows = keep(rows, "rank-bags")
            n_docs, n_all = rows.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            if not n_docs:
                continue
            df = document_counts(rows, len(index.vocabulary))
            weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
            classed = rows.where(F.octet_length("terms") > 0).withColumn("m", F.expr(f"75 + (25L * n * {n_docs}L) div {n_all}L"))
            classes = keep(classes_of(classed, k), "rank-classes")
            best = class_scores(classes, index, len(own), weights, k)
            first = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "class")
            best = best.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k)
            members = classes.select("class", "doc_id", "place")
            every = best.select("item", "score", "class").join(members, "class")
            order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "class", "place")
            every = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, int(r)) for i, r in enumerate(own)], "item long, _item long")  # the block's items
            found = every.join(names, "item").join(listed.select("_item", "item_id"), "_item")
            found = found.select("_item", "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "class")
            found = stage(found, "ranked")
            out = found if out is None else out.unionByName(found)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"_item long, item_id {kind}, rank int, doc_id long, score long, class long")
    return out
