"""Similarity join on sets of word n-grams, by prefix filters under several global orders of the tokens.

If two sets of n tokens or more are similar enough, all but a few tokens of each are in the other: ``missing`` of the
smaller set at most. So under any order of all tokens they share one of the first ``missing + 1`` tokens of each. An order
with rare tokens first makes that a strict test; several orders that differ among equally frequent tokens make several,
and only pairs that pass under every order are verified on their full sets. No pair can be lost.

1. Rows with equal sets are one class, a node of the join.
2. Of one token in ``SAMPLE`` it is found which occur in one class alone. A class with more such tokens than may be missing
   has no partner. The others are read again, whole, and the same test is made on all their tokens, which are
   counted among them: a token of one class needs no row from here on, only its place at the front of every order.
3. Under each order (frequency, then a hash of the token that differs by order) a class keeps the tokens of its prefix.
   Those of the first order are posted. The smaller of two sets must even meet the larger within its first
   ``missing`` tokens of twice the overlap, which fewer lists can offer; lists without such a member are dropped.
4. Every list elects the member with the fewest tokens of its own, the centre of a group of edited copies, and pairs each
   other member with it alone. Pairs that share prefix tokens under the other orders too are verified, and the links
   joined into first components.
5. Only lists that still hold several components are gone through in full, in pairs of blocks of at most about ``BLOCK``
   members and ``BLOCK_TOKENS`` tokens. A cell tests pairs from two components against sizes, own tokens and all orders,
   each pair under its first common token alone, and verifies what passes on the full sets. A link joins two components
   for the rest of the cell, so a cell hands on fewer links than it has members, however many of its pairs are alike.

Links within a component add nothing to the result, so no group of copies is ever written out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.graph import components
from tidemark.llm.text import WordHashes, gram_hashes, spaced_words
from tidemark.runtime import stage, staging, unstage, working

WIDTH, LEAST = 3, 90  # words to a token; similarity in hundredths
ORDERS = 3
SAMPLE = 4
BLOCK, BLOCK_TOKENS = 1024, 1 << 20
FILTERED = 10_000_000  # classes that a filter of 16 MB tells apart; beyond it all sets go to the join


def token_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct n-gram hashes, sorted; fewer words than ``width`` are one token."""
    return np.unique(gram_hashes(hashes, min(width, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _per_text(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of up to 500 rows with the token set of each text."""
    seen = WordHashes()
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            yield part, [token_set(seen.of(spaced_words(t.as_py())), width) for t in part.column(column)]


class _Once:
    """Keys a task has not met before, or so long ago that it forgot them."""

    def __init__(self):
        self.met: set[bytes] = set()

    def new(self, key: bytes) -> bool:
        if key in self.met:
            return False
        if len(self.met) >= 200_000:
            self.met.clear()
        self.met.add(key)
        return True


def rows_with_keys(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, key, node`` of every row; ``node`` is half of ``key``, both NULL without words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _per_text(batches, 1, width):
            keys = [set_key(s) if len(s) else None for s in sets]
            nodes = [int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64())],
                names=["doc_id", "n_shingles", "key", "node"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(read, "doc_id long, n_shingles long, key binary, node long")


def sampled_tokens(docs: DataFrame, width: int, shortest: int, sample: int) -> DataFrame:
    """``node, token`` for the tokens whose hash is divisible by ``sample``, of sets of ``shortest`` tokens or more."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for _, sets in _per_text(batches, 0, width):
            nodes, tokens = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for s in sets:
                if len(s) >= shortest and once.new(key := set_key(s)):
                    tokens.append(s[s % np.uint64(sample) == 0])
                    nodes.append(np.full(len(tokens[-1]), int.from_bytes(key[:8], "little", signed=True)))
            flat = [np.concatenate(nodes), np.concatenate(tokens).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["node", "token"])

    return docs.select(F.col("text").cast("string")).mapInArrow(read, "node long, token long")


def live_sets(docs: DataFrame, live: DataFrame, width: int) -> DataFrame:
    """``node, n, tokens`` of the classes in ``live`` (``node, key, n``), from another pass over the texts."""
    n = live.count()
    bits = max(16, math.ceil(math.log2(12 * n + 1)))
    table = docs.sparkSession.sparkContext.broadcast(bloom.build(live, "node", bits)) if n <= FILTERED else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for _, sets in _per_text(batches, 0, width):
            keyed = [(set_key(s), s) for s in sets if len(s)]
            if table is not None and keyed:
                nodes = np.frombuffer(b"".join(k[:8] for k, _ in keyed), np.uint64)
                keyed = [pair for pair, passed in zip(keyed, bloom.passes(table.value, bits, nodes), strict=True) if passed]
            keyed = [(k, s) for k, s in keyed if once.new(k)]
            ends = np.cumsum([0, *(len(s) for _, s in keyed)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *(s for _, s in keyed)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keyed], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "tokens"]
            )

    sets = docs.select(F.col("text").cast("string")).mapInArrow(read, "key binary, tokens array<long>")
    return sets.join(live, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("node", "n", "tokens")]).drop("key")


def able(n_a: Column, own_a: Column, n_b: Column, own_b: Column, least: int) -> Column:
    """Whether sizes, and tokens that no other set has, leave room for enough overlap."""
    most = F.least(n_a - own_a, n_b - own_b)
    return (100 * F.least(n_a, n_b) >= least * F.greatest(n_a, n_b)) & ((100 + least) * most >= least * (n_a + n_b))


def prefixes(sets: DataFrame, least: int, orders: int) -> DataFrame:
    """``node, n, own, token, r0, r1, ...``: tokens in the prefix of a class under some order, with their ranks there.

    ``own`` tokens of the class occur in no other and come first in every order, without a row; ranks count from 1 after
    them. Classes with more of them than may be missing have no rows.
    """
    posts = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of_node = W.partitionBy("node")
    rows = posts.join(shared, "token").withColumn("own", F.col("n") - F.count(F.lit(1)).over(of_node))
    rows = rows.withColumn("need", F.expr(f"n * {100 - least} div 100") + 1 - F.col("own")).where("need > 0")
    ranks = {f"r{k}": F.row_number().over(of_node.orderBy("df", F.xxhash64("token", F.lit(k)))) for k in range(orders)}
    within = [F.col(r) <= F.col("need") for r in ranks]
    return rows.withColumns(ranks).where(reduce(or_, within)).drop("df")


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap in at least ``least`` hundredths of their union."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return both.where(100 * shared >= least * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _meeting(prefix: list[np.ndarray], mine: np.ndarray) -> np.ndarray:
    """Which of the prefixes share a token with ``mine``."""
    owner = np.repeat(np.arange(len(prefix)), list(map(len, prefix)))
    hit = np.isin(np.concatenate([*prefix, np.empty(0, np.int64)]), mine)
    return np.bincount(owner[hit], minlength=len(prefix)) > 0


def cell_links(least: int, others: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Links of one cell between components: candidates of fit sizes, met early enough and under all orders, verified."""

    def links(cell: pa.Table) -> pa.Table:
        node, n, own, block, comp = (cell.column(c).to_numpy() for c in ("node", "n", "own", "block", "component"))
        comp, early = comp.copy(), cell.column("early").to_numpy(zero_copy_only=False)
        numbers = lambda c: [x.values.to_numpy() for x in cell.column(c)]
        prefix, first_order, tokens = {c: numbers(c) for c in others}, numbers("p0"), numbers("tokens")
        token, first, second = (cell.column(c)[0].as_py() for c in ("token", "first", "second"))
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(block == first):
            j = np.flatnonzero(block == second)
            j = j[(comp[j] != comp[i]) & (node[j] > node[i] if first == second else True)]
            smaller = np.where((n[j] < n[i]) | ((n[j] == n[i]) & (node[j] < node[i])), j, i)
            most = np.minimum(n[j] - own[j], n[i] - own[i])
            j = j[early[smaller] & (100 * np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i])) & ((100 + least) * most >= least * (n[j] + n[i]))]
            for c in others:
                j = j[_meeting([prefix[c][k] for k in j], prefix[c][i])] if len(j) else j
            for k in j:
                if comp[k] == comp[i]:
                    continue
                # a pair is tested under the first token at which the smaller set meets the larger early enough
                small, large = (k, i) if (n[k], node[k]) < (n[i], node[i]) else (i, k)
                reach = n[small] * (100 - least) // (100 + least) + 1 - own[small]
                if first_order[small][:reach][np.isin(first_order[small][:reach], first_order[large])][0] != token:
                    continue
                shared = len(np.intersect1d(tokens[i], tokens[k], assume_unique=True))
                if 100 * shared >= least * (n[i] + n[k] - shared):
                    out.append((int(min(node[i], node[k])), int(max(node[i], node[k]))))
                    comp[comp == comp[k]] = comp[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def links_of(sets: DataFrame, least: int = LEAST, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of similar classes, enough of them to connect all that are: from ``node, n, tokens``."""
    others = [f"p{k}" for k in range(1, orders)]
    with staging() as keep:
        prefix = keep(prefixes(sets, least, orders), "join-prefix")
        under = [F.array_sort(F.collect_list(F.when(F.col(f"r{k}") <= F.col("need"), F.col("token")))).alias(f"p{k}") for k in range(1, orders)]
        by_rank = F.array_sort(F.collect_list(F.when(F.col("r0") <= F.col("need"), F.struct("r0", "token"))))
        under.append(F.transform(by_rank, lambda x: x["token"]).alias("p0"))
        sides = prefix.groupBy("node").agg(F.first("n").alias("n"), F.first("own").alias("own"), *under)
        sides = keep(sides, "join-sides")
        early = F.col("own") + F.col("r0") <= F.expr(f"n * {100 - least} div {100 + least}") + 1
        posts = keep(prefix.where("r0 <= need").select("token", "node", "n", "own", early.alias("early")), "join-posts")
        size = F.count(F.lit(1)).alias("_n")
        lists = posts.groupBy("token").agg(size, F.max("early").alias("_early"), F.min(F.struct("own", "node")).alias("_centre"))
        lists = keep(lists.where("_n > 1 AND _early").select("token", F.col("_centre.node").alias("centre")), "join-lists")

        stars = posts.join(lists, "token").where("node != centre")
        stars = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        side = lambda k: sides.select(*[F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in sides.columns if c != "p0"])
        met = able(*[F.col(c) for c in ("n_a", "own_a", "n_b", "own_b")], least)
        for c in others:
            met = met & F.arrays_overlap(f"{c}_a", f"{c}_b")
        stars = stars.join(side("a"), "a").join(side("b"), "b").where(met).select("a", "b")
        links = keep(verified(stars, sets, least), "join-links")

        first = keep(components(links, "join-first"), "join-components")
        named = posts.join(lists.select("token"), "token").join(first, "node", "left")
        named = keep(named.withColumn("component", F.coalesce("component", "node")), "join-named")
        mixed = named.groupBy("token").agg(size, F.sum("n").alias("_all"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        blocks = F.ceil(F.greatest(F.col("_n") / block, F.col("_all") / BLOCK_TOKENS)).cast("int")
        mixed = mixed.where("_lo != _hi").select("token", blocks.alias("_blocks"))
        cells = named.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("token", "node"), F.col("_blocks")).cast("int"))
        cells = cells.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        cells = cells.withColumns({"first": F.least("block", "_other"), "second": F.greatest("block", "_other")})
        cells = cells.join(sides.select("node", "p0", *others), "node").join(sets.select("node", "tokens"), "node")
        cells = cells.select("token", "first", "second", "block", "node", "n", "own", "early", "component", "p0", *others, "tokens")
        rest = cells.groupBy("token", "first", "second").applyInArrow(cell_links(least, others), "a long, b long")
        return stage(links.union(rest.distinct()), "join-all-links")


def ngram_join(docs: DataFrame, width: int = WIDTH, least: int = LEAST, orders: int = ORDERS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """A row per input row: ``doc_id, n_shingles, component_id, class_id``.

    Words are white-space separated, A to Z lower-cased; the set holds the distinct runs of ``width`` words, or all words if
    there are fewer. Rows link if ``100 * intersection >= least * union`` of their sets (64-bit hashes of the runs).
    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest that links reach. Every row is a
    document of its own, whatever its id: rows that share one are linked by their texts alone, and rows with a NULL id link
    like others, with the smallest id that is not NULL as their result, or NULL if there is none. Texts that are NULL, empty
    or white space have no set and no links. Other columns are ignored; no rows give no rows.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be over 0 and at most 100")
    shortest = -(-least // (100 - least)) if least < 100 else 1 << 62  # shorter sets are similar to equal ones alone
    with working() as hold, staging() as keep:
        rows = keep(rows_with_keys(docs, width), "join-rows")
        classes = rows.where("key IS NOT NULL").groupBy("key").agg(
            F.first("node").alias("node"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")
        )
        classes = keep(classes, "join-classes")
        alone = sampled_tokens(docs, width, shortest, sample).groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("_last"))
        alone = alone.where("node = _last").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        fit = F.coalesce("own", F.lit(0)) <= F.expr(f"n * {100 - least} div 100")
        live = classes.where(F.col("n") >= shortest).join(alone, "node", "left").where(fit).select("node", "key", "n")
        live = keep(live, "join-live")
        sets = keep(live_sets(docs, live, width), "join-sets")
        links = links_of(sets, least, orders, block)
        grouped = keep(components(links, "join-groups"), "join-groups")
        unstage(links)

        named = classes.join(grouped, "node", "left")
        least_id = grouped.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("least_id"))
        named = named.join(least_id, "component", "left").where("copies > 1 OR least_id IS NOT NULL")
        named = named.select("key", "class_id", F.coalesce("least_id", "class_id").alias("component_id"))
        out = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left")
        out = out.select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
        )
        return hold(stage(out, "join-result"))
