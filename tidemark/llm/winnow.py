"""Benchmark decontamination by winnowing.

Of every ``window - gram + 1`` consecutive k-gram hashes the least is kept (the last of equals), in documents and in
benchmark items alike. Two texts that share ``window`` consecutive words therefore share a kept fingerprint inside that
span, so joining fingerprints finds every such span. A hit carries the words around its k-gram as far as a window can
reach; it is extended over them while both sides agree, and counts if it comes to ``window`` words. The words themselves
are compared, so a hash collision cannot make a hit. Items shorter than a window have one fingerprint, of all their words.

Many texts share a k-gram without sharing a window, such as the opening of a question. So a fingerprint is joined together
with the windows around it, a hash each, and items whose windows have the same words are one context until the end: rows are
joined only where a window is shared, and once for all items that have it.

Documents are read once. Before a fingerprint leaves its task it is looked up, with its windows, in a Bloom filter of the
items' fingerprints and windows, whose size is a parameter and not a matter of the data; what passes wrongly is lost in
the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.text import WordHashes, alphanumeric_words, gram_hashes
from tidemark.runtime import stage, unstage, working

WINDOW, GRAM = 10, 5
FILTER_BITS = 23  # 2 ** 23 bits, 1 MB: 1 in 100 of unrelated fingerprints pass at about 400,000 item fingerprints
HITS = "array<struct<fp long, key long, n int, pos int, lead int, words array<string>>>"


def kept(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash of each ``width`` consecutive ones, the last of equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = np.argmin(np.stack([hashes[k : k + n] for k in range(width - 1, -1, -1)]), axis=0)
    return np.unique(np.arange(n) + (width - 1 - least))


def fingerprints(words: list[bytes], hashes: np.ndarray, lengths: list[int], window: int, gram: int, passes):
    """``(fp, key, n, pos, lead, words)`` of the kept k-grams, once for each window around them, and of all runs of ``lengths``.

    ``key`` is the hash of the window, ``words`` are its words, ``pos`` the place of its first one and ``lead`` that of the
    k-gram within it. Only fingerprints and windows that ``passes`` lets through are given.
    """
    grams = gram_hashes(hashes, gram)
    at = kept(grams, window - gram + 1)
    at = at[passes(grams[at])]
    if len(at):
        windows = gram_hashes(hashes, window)
        pos = np.repeat(at, window - gram + 1) - np.tile(np.arange(window - gram + 1), len(at))
        of = np.repeat(at, window - gram + 1)
        inside = (pos >= 0) & (pos < len(windows))
        pos, of = pos[inside], of[inside]
        through = passes(windows[pos])
        for p, g in zip(pos[through].tolist(), of[through].tolist(), strict=True):
            around = [w.decode("utf-8", "replace") for w in words[p : p + window]]
            yield int(grams[g].view(np.int64)), int(windows[p].view(np.int64)), gram, p, g - p, around
    for n in lengths:
        runs = gram_hashes(hashes, n)
        for p in np.flatnonzero(passes(runs)).tolist():
            fp = int(runs[p].view(np.int64))
            yield fp, fp, -n, p, 0, [w.decode("utf-8", "replace") for w in words[p : p + n]]


def _hits_of(rows: list[list[tuple]]) -> pa.Array:
    names = ("fp", "key", "n", "pos", "lead", "words")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    flat = [dict(zip(names, hit, strict=True)) for hits in rows for hit in hits]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.struct(list(zip(names, kinds, strict=True)))))


def _reader(lengths: list[int], window: int, gram: int, filtered, bits: int, whole: bool) -> Callable:
    """Arrow batches of (id, text) to (id, n_words, hits). ``whole``: a text shorter than a window is one run itself."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        table = None if filtered is None else filtered.value

        def through(fps: np.ndarray) -> np.ndarray:
            return np.ones(len(fps), bool) if table is None else bloom.passes(table, bits, fps)

        for batch in batches:
            counts, rows = [], []
            for text in batch.column(1):
                words = alphanumeric_words(text.as_py())
                counts.append(len(words))
                runs = ([len(words)] if 0 < len(words) < window else []) if whole else lengths
                rows.append(list(fingerprints(words, seen.of(words), runs, window, gram, through)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), _hits_of(rows)], names=[batch.schema.names[0], "n_words", "hits"]
            )

    return read


def _extended(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Hits whose k-gram extends over equal words, left and right, to a whole window (or is a whole shorter item)."""
    for batch in batches:
        keep: list[tuple] = []
        rows = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)
        for row, context, n, pos, lead, words, their_lead, their_words in rows:
            size = abs(n)
            if words[lead : lead + size] != their_words[their_lead : their_lead + size]:
                continue
            left = right = 0
            while left < min(lead, their_lead) and words[lead - left - 1] == their_words[their_lead - left - 1]:
                left += 1
            room = min(len(words) - lead, len(their_words) - their_lead) - size
            while right < room and words[lead + size + right] == their_words[their_lead + size + right]:
                right += 1
            if n < 0 or left + size + right >= window:
                keep.append((row, context, pos + lead - left, pos + lead + size + right))
        cols = list(zip(*keep, strict=True)) if keep else [[], [], [], []]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_doc", "_context", "start", "end"])


def item_fingerprints(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the distinct word sequences, and which ``item_id`` has which sequence. Both written."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(alphanumeric_words(t.as_py())).decode() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    plain = items.select(F.col("item_id").cast("string"), "text").mapInArrow(joined, "item_id string, text string")
    plain = stage(plain.where("text != ''").withColumn("_item", F.sha2("text", 256)), "items")
    texts = plain.groupBy("_item").agg(F.first("text").alias("text"))
    prints = texts.mapInArrow(_reader([], window, gram, None, 0, True), f"_item string, n_words long, hits {HITS}")
    context = F.sha2(F.concat_ws(" ", "n", "lead", F.concat_ws(" ", "words")), 256).alias("_context")
    return stage(prints.select("_item", F.inline("hits")).select("*", context), "item-prints"), plain.select("_item", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Documents with their word counts, and the spans that items share with them.

    ``docs`` has ``doc_id, text``, the id of any type; ``items`` has ``item_id, text``. The first result has a row ``_doc, doc_id, n_words``
    per input row (``_doc`` tells repeated ids apart), the second ``_doc, item_id, start, end`` per hit, in words, end
    exclusive. Words are runs of letters, digits and non-ASCII characters, A to Z lower-cased. NULL and wordless texts
    have no words and no hits; an item of fewer words than a window occurs where all of them do; items with equal words
    share their hits. Empty tables give no rows or no hits.
    """
    prints, ids = item_fingerprints(items, window, gram)
    lengths = sorted(-r["n"] for r in prints.where("n < 0").select("n").distinct().collect())  # at most window - 1
    looked_up = prints.select(F.explode(F.array("fp", "key")).alias("hash")).distinct()
    table = docs.sparkSession.sparkContext.broadcast(bloom.build(looked_up, "hash", bits))
    read = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _reader(lengths, window, gram, table, bits, False),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, hits {HITS}",
    )
    read = stage(read.withColumn("_doc", F.monotonically_increasing_id()), "doc-prints")
    contexts = prints.groupBy("_context").agg(
        *[F.first(c).alias(c) for c in ("fp", "key", "n")], F.first("lead").alias("_lead"), F.first("words").alias("_words")
    )
    met = read.select("_doc", F.inline("hits")).join(contexts, ["fp", "key", "n"])
    spans = (
        met.select("_doc", "_context", "n", "pos", "lead", "words", "_lead", "_words")
        .mapInArrow(lambda batches: _extended(batches, window), "_doc long, _context string, start long, end long")
        .distinct()
    )
    spans = stage(spans, "doc-spans")
    of_item = stage(prints.select("_context", "_item").distinct().join(ids, "_item").select("_context", "item_id").distinct(), "item-contexts")
    unstage(prints)
    return read.select("_doc", "doc_id", "n_words"), spans.join(of_item, "_context").select("_doc", "item_id", "start", "end")


def covered(spans: DataFrame) -> DataFrame:
    """``_doc, n_hit``: words in at least one span."""
    before = W.partitionBy("_doc").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_reach"))
    once = spans.select("_doc", "start", "end").distinct()
    return once.withColumn("_reach", reach).groupBy("_doc").agg(F.sum(new).cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``items_sha256`` is the digest of the ids of the items met, sorted as strings and joined by commas (of the empty
    string if there are none); NULL item ids are not listed.
    """
    with working() as keep:
        read, spans = decontaminate(docs.select(F.col("doc_id").cast("long"), "text"), items, window, gram, bits)
        met = spans.select("_doc", "item_id").distinct().groupBy("_doc").agg(
            F.count("item_id").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_set("item_id"))).alias("_ids")
        )
        found = covered(spans).join(met, "_doc")
        out = read.join(found, "_doc", "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("_ids", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
        return keep(stage(out, "contamination"))
