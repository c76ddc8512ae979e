"""Near duplicates by an inverted join of MinHash signatures.

1. One pass over the texts writes the first ``POSTED`` coordinates of each document's signature and a key of its shingle
   set. Documents with equal sets are one class and go on as its representative, so copies are never paired.
2. Representatives are posted under these coordinates. Values that nobody shares are dropped, and with
   them every document left with fewer than ``SHARED`` coordinates: it can match nobody often enough (skip). Of the
   others the ``SHARED - 1`` most frequent coordinates are dropped: two documents that agree in ``SHARED`` still meet
   under their rarest common value (prefix). Boilerplate that many documents contain falls away here. A second pass
   writes the sets and the whole signatures of the documents that are left.
3. Every posting list elects the member whose values are the most common, which is the centre of a group of edited
   copies, and each other member is paired with it alone. Pairs that agree in ``MATCHES`` of ``COORDINATES`` are confirmed
   on the full sets, and the links joined into first components.
4. Only lists that still hold more than one component are gone through in full, in pairs of blocks of at most about
   ``BLOCK`` documents, inside a task: counted on the signatures, and only pairs from two components that reach
   ``MATCHES`` leave it, each under its least common value. They are confirmed alike, and all links give the components.
   The members of a list's largest component, which are linked already, never meet each other there: they go to the blocks
   of the other members alone, so a large group that few documents are apart from costs a row a member.

At a similarity of 0.75 a pair agrees in 576 of 768 coordinates on average with a deviation of 12, so about one in 20,000
such pairs misses ``MATCHES``; one in 200,000 misses ``SHARED``. More similar pairs miss far less often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.graph import components
from tidemark.llm.text import WordHashes, gram_hashes, spaced_words
from tidemark.runtime import stage, unstage, working

SHINGLE = 5
COORDINATES, MATCHES = 768, 529
POSTED, SHARED = 24, 8
BLOCK = 256
FILTERED = 10_000_000  # documents that a Bloom filter of 16 MB tells apart; beyond it all sets go to the join


def shingle_set(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted; fewer words than a shingle are one shingle."""
    return np.unique(gram_hashes(hashes, min(width, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of each hash function over the set, in slices so that long texts take no more memory."""
    factors, shifts = functions
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 1024):
        values = factors[:, None] * high[None, at : at + 1024]
        values += shifts[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` of one fixed row of hash functions."""
    dice = np.random.default_rng(75)
    factors = dice.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors[:n], dice.integers(0, 2**32, COORDINATES, dtype=np.uint32)[:n]


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _reader(names: list[str]):
    """Arrow batches with the text last to batches with its number of shingles, key and posted coordinates instead."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = hash_functions(POSTED)
        places = np.arange(POSTED, dtype=np.uint64) << np.uint64(32)
        seen = WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                counts, keys, posted = [], [], []
                for text in part.column(part.num_columns - 1):
                    shingles = shingle_set(seen.of(spaced_words(text.as_py())))
                    counts.append(len(shingles))
                    keys.append(_key(shingles) if len(shingles) else None)
                    posted.append(places | signature(shingles, functions) if len(shingles) else np.empty(0, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), _lists(posted)],
                    names=[*names, "n_shingles", "key", "posted"],
                )

    return read


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, signature of a, signature of b) that agree in MATCHES coordinates."""
    for batch in batches:
        same = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(axis=1)
        yield batch.select([0, 1]).filter(pa.array(same >= MATCHES))


def _met_first(left: list[int], right: list[int], key: int) -> bool:
    """Whether ``key`` is the least value under which the two documents meet."""
    return min(set(left).intersection(right)) == key


def _cell_pairs(cell: pa.Table) -> list[tuple[int, int]]:
    key, first, second = (cell.column(c)[0].as_py() for c in ("key", "first", "second"))
    nodes = cell.column("node").to_numpy()
    comps = cell.column("component").to_numpy()
    if len(nodes) < 2 or (comps == comps[0]).all():
        return []
    sizes, own = cell.column("n_shingles").to_numpy(), cell.column("own").to_numpy()
    block = cell.column("block").to_numpy()
    prefixes = cell.column("prefix").to_pylist()
    marks = _signatures(cell.column("signature"))
    out = []
    for i in np.flatnonzero(block == first):
        others = np.flatnonzero(block == second)
        others = others[(comps[others] != comps[i]) & (others > i if first == second else True)]
        others = others[4 * np.minimum(sizes[others], sizes[i]) >= 3 * np.maximum(sizes[others], sizes[i])]
        most = np.minimum(sizes[others] - own[others], sizes[i] - own[i])
        others = others[7 * most >= 3 * (sizes[others] + sizes[i])]
        for j in others[(marks[others] == marks[i]).sum(axis=1) >= MATCHES]:
            if _met_first(prefixes[i], prefixes[j], key):
                out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by cell (key, first, second), one cell at a time."""
    held: pa.Table | None = None

    def paired(cells: list[pa.Table]) -> pa.RecordBatch:
        pairs = [p for c in cells for p in _cell_pairs(c)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        marks = [held.column(c).to_numpy() for c in ("key", "first", "second")]
        turns = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        starts = [0, *turns.tolist()]
        yield paired([held.slice(a, b - a) for a, b in zip(starts, starts[1:], strict=False)])
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield paired([held])


def shingle_sets(docs: DataFrame, live: DataFrame) -> DataFrame:
    """``_doc, node, n_shingles, signature, shingles`` of the documents in ``live`` (_doc, node, key), from a second pass.

    Keeping every document's set from the first pass would take more room than the texts, and few are needed: sets whose
    key is in ``live``, each once a task, before one join by key. The filter of the keys grows with their number.
    """
    n = live.count()
    bits = max(16, math.ceil(math.log2(12 * n + 1)))
    hashes = live.select(F.xxhash64("key").alias("hash"))
    table = docs.sparkSession.sparkContext.broadcast(bloom.build(hashes, "hash", bits)) if n <= FILTERED else None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, functions = WordHashes(), hash_functions(COORDINATES)
        sent: set[bytes] = set()

        def short(shingles: np.ndarray) -> bytes:
            least = signature(shingles, functions)
            return (least ^ (least >> np.uint32(16))).astype(np.uint16).tobytes()

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                found = [shingle_set(seen.of(spaced_words(t.as_py()))) for t in batch.column(0).slice(first, 500)]
                keyed = {_key(r): r for r in found if len(r)}
                if table is not None and keyed:
                    hashes = np.array([xxhash.xxh64_intdigest(k, seed=42) for k in keyed], np.uint64)  # Spark's xxhash64
                    passed = bloom.passes(table.value, bits, hashes)
                    keyed = {k: r for (k, r), p in zip(keyed.items(), passed, strict=True) if p}
                keyed = {k: r for k, r in keyed.items() if k not in sent}
                if len(sent) > 200_000:
                    sent.clear()
                sent.update(keyed)
                rows = list(keyed.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(keyed), pa.binary()),
                        pa.array([len(r) for r in rows], pa.int64()),
                        pa.array([short(r) for r in rows], pa.binary()),
                        _lists(rows),
                    ],
                    names=["key", "n_shingles", "signature", "shingles"],
                )

    read = docs.select(F.col("text").cast("string"))
    read = read.mapInArrow(sets, "key binary, n_shingles long, signature binary, shingles array<long>")
    whole = read.join(live.select("_doc", "node", "key"), "key").groupBy("key")
    return whole.agg(*[F.first(c).alias(c) for c in ("_doc", "node", "n_shingles", "signature", "shingles")]).drop("key")


def own_shingles(sets: DataFrame) -> DataFrame:
    """``_doc, own``: how many shingles of a text are in no other one of ``sets``; counts merge before the shuffle."""
    shingles = sets.select("_doc", F.explode("shingles").alias("shingle"))
    alone = shingles.groupBy("shingle").agg(F.min("_doc").alias("_doc"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return alone.groupBy("_doc").agg(F.count(F.lit(1)).alias("own"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (``node, n_shingles, shingles``) overlap in at least 75 of 100 of their union."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("shingles").alias(f"s_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * shared >= 75 * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b").distinct()


def blocks_met(named: DataFrame) -> DataFrame:
    """Members (``_doc, node, key, component``) of lists with several components, with their ``block`` in the list and
    ``_others``, the blocks it meets.

    The members of the list's largest component lie in blocks -1, -2, ... and meet the others alone, which lie in 0, 1, ...
    """
    parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("_most"), F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_parts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    lists = lists.where("_parts > 1").select(
        "key", F.col("_most.component").alias("_largest"), blocks(F.col("_most.n")).alias("_in"), blocks(F.col("_all") - F.col("_most.n")).alias("_out")
    )
    inside = F.col("component") == F.col("_largest")
    dealt = lambda of: F.pmod(F.xxhash64("key", "_doc"), F.col(of)).cast("int")
    return named.join(lists, "key").select(
        *named.columns,
        F.when(inside, -1 - dealt("_in")).otherwise(dealt("_out")).alias("block"),
        F.sequence(F.when(inside, 0).otherwise(-F.col("_in")), F.col("_out") - 1).alias("_others"),
    )


def linked(docs: DataFrame, node: str | None = None) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``n_shingles, class_node, component`` of the text.

    Nodes of the graph are the rows, numbered as they are read, or the values of the column ``node``: rows that share one
    are one document, and those where it is NULL are not linked. ``class_node`` is the smallest node with the same set,
    ``component`` the smallest that links reach; both are NULL where nothing can be linked.
    """
    names = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    with working() as keep:
        read = docs.select(*names, F.col("text").cast("string"))
        read = read.mapInArrow(_reader(names), f"{kinds}n_shingles long, key binary, posted array<long>")
        read = stage(read.withColumn("_doc", F.monotonically_increasing_id()), "dup-read")
        node_of = F.col(node or "_doc")
        usable = read.where(F.col("key").isNotNull() & node_of.isNotNull()).withColumn("node", node_of)
        classes = usable.groupBy("key").agg(F.min(F.struct("node", "_doc")).alias("_rep"), F.count(F.lit(1)).alias("_n"))
        classes = stage(classes.select("key", F.col("_rep.node").alias("class_node"), F.col("_rep._doc").alias("_doc"), "_n"), "dup-classes")

        reps = usable.select("_doc", "node", "posted").join(classes.select("_doc"), "_doc")
        posts = stage(reps.select("_doc", "node", F.explode("posted").alias("key")), "dup-posts")
        shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        of_doc = W.partitionBy("_doc")
        ranked = (
            posts.join(shared, "key")
            .withColumns(
                {
                    "_have": F.count(F.lit(1)).over(of_doc),
                    "_weight": F.sum("n").over(of_doc),
                    "_rank": F.row_number().over(of_doc.orderBy(F.desc("n"), F.desc("key"))),
                }
            )
            .where((F.col("_have") >= SHARED) & (F.col("_rank") >= SHARED))
        )
        prefix = stage(ranked.select("_doc", "node", "key", "_weight"), "dup-prefix")
        unstage(posts)
        live = prefix.groupBy("_doc").agg(F.first("node").alias("node"), F.array_sort(F.collect_list("key")).alias("prefix"))
        live = stage(live.join(usable.select("_doc", "key"), "_doc"), "dup-live")

        sets = stage(shingle_sets(docs, live), "dup-sets")
        own = sets.select("_doc", "n_shingles").join(own_shingles(sets), "_doc", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        able = stage(own.where(4 * F.col("own") <= F.col("n_shingles")).select("_doc", "own"), "dup-able")
        whole, prefix = prefix, stage(prefix.join(able.select("_doc"), "_doc"), "dup-able-prefix")
        unstage(whole)

        centre = prefix.groupBy("key").agg(F.max(F.struct("_weight", (-F.col("node")).alias("_o"), "node")).alias("_c"), F.count(F.lit(1)).alias("n"))
        stars = (
            prefix.join(centre.where("n > 1").select("key", F.col("_c.node").alias("b")), "key")
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
            .where("a != b")
            .distinct()
        )
        marks = lambda k: sets.select(F.col("node").alias(k), F.col("signature").alias(f"m_{k}"))
        stars = stars.join(marks("a"), "a").join(marks("b"), "b").select("a", "b", "m_a", "m_b").mapInArrow(_enough, "a long, b long")
        links = stage(confirmed(stars.distinct(), sets), "dup-links")
        first = stage(components(links, "dup-first"), "dup-first")

        named = prefix.join(first, "node", "left").select("_doc", "node", "key", F.coalesce("component", "node").alias("component"))
        named = stage(named, "dup-named")
        blocks = (
            blocks_met(named)
            .join(live.select("_doc", "prefix"), "_doc")
            .join(sets.select("_doc", "n_shingles", "signature"), "_doc")
            .join(able, "_doc")
            .withColumn("_other", F.explode("_others"))
            .select(
                "key",
                F.least("block", "_other").alias("first"),
                F.greatest("block", "_other").alias("second"),
                "block",
                "node",
                "component",
                "n_shingles",
                "own",
                "signature",
                "prefix",
            )
        )
        cells = blocks.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
        rest = stage(cells.mapInArrow(_cells, "a long, b long").distinct(), "dup-rest")
        more = stage(confirmed(rest, sets), "dup-more")
        grouped = stage(components(links.union(more), "dup-groups"), "dup-groups")
        for t in (prefix, live, sets, able, links, first, named, rest, more):
            unstage(t)

        copies = classes.where("_n > 1").select("key", F.col("class_node").alias("_class"))
        out = read.withColumns({"_node": F.when(F.col("key").isNotNull(), node_of), "key": F.when(node_of.isNotNull(), F.col("key"))})
        out = out.join(copies, "key", "left").withColumn("class_node", F.coalesce("_class", "_node"))
        out = out.join(grouped.select(F.col("node").alias("class_node"), "component"), "class_node", "left")
        out = out.select(*names, "n_shingles", "class_node", F.coalesce("component", "class_node").alias("component"))
        return keep(stage(out, "dup-result"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per input row: ``doc_id, n_shingles, class_id, component_id, kept``.

    Words are white-space separated, A to Z lower-cased; the set holds the distinct runs of five words, or all words if
    there are fewer. Documents are linked if their sets overlap in at least 0.75 of their union; ``class_id`` is the
    smallest id with the same set, ``component_id`` the smallest id reachable over links, and a document is kept if that
    is its own. Texts that are NULL, empty or white space have no shingles and no links. Rows that repeat an id are one
    document; a NULL id is never linked and is kept. Other columns are ignored; no rows give no rows.
    """
    found = linked(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_node", "doc_id").alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
