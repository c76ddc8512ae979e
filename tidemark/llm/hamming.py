"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into four segments of 16 bits and indexed under each. In round r every open query meets the rows
that differ from it in exactly r bits of a segment. Two codes that differ in at most ``4 r + 3`` bits differ in at most r
bits of some segment, so after round r all rows up to that distance have been seen: a query is closed once that covers
``k`` of its verified neighbours, and only open queries go on.

Rows with equal codes are one class with its smallest ids, since no more of them can be among the k nearest. Classes and
queries meet in cells: a segment and the first bits of its value, as many bits as leave about ``CELL`` classes to a cell. A
query visits the cells whose first bits are near enough and probes there for the rest of the radius; a cell hands on at
most the k best of each query, and none that is farther than the query's k-th best so far. Where codes agree in those bits
so that a cell is larger, its classes are dealt into parts of that size and its visits go to each. So no pairs are emitted
but the best ones, and no task holds more than a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import stage, unstage

SEGMENTS, WIDTH = 4, 16
CELL = 65_536  # classes of a cell or a part of one
LEAST_ROUTE, MOST_ROUTE = 6, 14  # first bits of a segment that name a cell
FAR = SEGMENTS * WIDTH + 1


def sign_code(column: str) -> Column:
    """The signs of an array of at most 64 numbers as the bits of a long (positive: 1); NULL stays NULL. More are an error."""
    bit = "transform({0}, (x, i) -> if(coalesce(x, 0) > 0, shiftleft(1L, i), 0L))".format(f"`{column}`")
    wide = F.raise_error(F.concat(F.lit("a sign code has 64 bits, not "), F.size(column).cast("string"))).cast("long")
    return F.when(F.size(column) > SEGMENTS * WIDTH, wide).otherwise(F.expr(f"aggregate({bit}, 0L, (a, b) -> a | b)"))


def masks(bits: int, flips: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(bits), flips)]


def _probed(codes: np.ndarray, firsts: np.ndarray, queries: np.ndarray, spare: np.ndarray, bound: np.ndarray, segment: int, k: int, route: int):
    """(query, code, distance) of the cell: segment distance as asked, at most k for each query, none beyond its bound."""
    low = np.uint64((1 << (WIDTH - route)) - 1)
    rest = lambda x: (x >> np.uint64(WIDTH * segment)) & low
    order = np.argsort(rest(codes), kind="stable")
    codes, firsts = codes[order], firsts[order]
    values = rest(codes)
    for flips in np.unique(spare):
        own = np.flatnonzero(spare == flips)
        probes = np.array(masks(WIDTH - route, int(flips)), np.uint64)
        if not len(probes):
            continue
        for a in range(0, len(own), 256):
            some = own[a : a + 256]
            wanted = rest(queries[some])[:, None] ^ probes[None, :]
            left, right = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            sizes = (right - left).ravel()
            if not sizes.sum():
                continue
            at = np.repeat(left.ravel() - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            asker = np.repeat(np.repeat(some, len(probes)), sizes)
            distance = np.bitwise_count(codes[at] ^ queries[asker]).astype(np.int64)
            near = distance <= bound[asker]
            at, asker, distance = at[near], asker[near], distance[near]
            best = np.lexsort((firsts[at], distance, asker))
            at, asker, distance = at[best], asker[best], distance[best]
            starts = np.flatnonzero(np.diff(asker, prepend=-1))
            place = np.arange(len(asker)) - np.repeat(starts, np.diff(np.append(starts, len(asker))))
            keep = place < k
            yield queries[asker[keep]], codes[at[keep]], distance[keep]


def _cells(batches: Iterator[pa.RecordBatch], k: int, route: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (segment, cell, part): classes (spare -1) and queries; one part at a time."""
    held: pa.Table | None = None

    def found(cell: pa.Table) -> pa.RecordBatch:
        spare = cell.column("spare").to_numpy()
        code = cell.column("code").to_numpy().view(np.uint64)
        extra = cell.column("extra").to_numpy()
        q = spare >= 0
        parts = list(_probed(code[~q], extra[~q], code[q], spare[q], extra[q], int(cell.column("segment")[0].as_py()), k, route)) if q.any() else []
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["query", "code", "distance"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        marks = [held.column(c).to_numpy() for c in ("segment", "cell", "part")]
        starts = [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield found(held.slice(a, b - a))
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield found(held)


def cell_bits(n: int, cell: int = CELL) -> int:
    """How many first bits of a segment leave about ``cell`` of ``n`` codes to a cell."""
    bits = LEAST_ROUTE
    while bits < MOST_ROUTE and n > cell << bits:
        bits += 1
    return bits


def _routed(rows: DataFrame, route: int) -> DataFrame:
    """Each code under each segment, with the first bits of its value there."""
    out = rows.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    top = f"cast(shiftrightunsigned(code, {WIDTH} * segment + {WIDTH - route}) & {(1 << route) - 1} as int)"
    return out.withColumn("cell", F.expr(top))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, cell: int = CELL) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest other rows of each query, by distance, then id.

    ``rows`` and ``queries`` have ``id, code`` (longs); NULLs in either are left out. A row with the query's own id is
    not its neighbour. Repeated rows (same id and code) count once. If there are fewer than k others, all are returned;
    no queries or no rows give no rows.
    """
    wanted = k + 1  # the query itself may be among them
    rows = rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    queries = stage(queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct(), "knn-queries")
    by_id = W.partitionBy("code").orderBy("id")
    firsts = rows.withColumn("_rn", F.row_number().over(by_id)).where(F.col("_rn") <= wanted)
    classes = firsts.groupBy("code").agg(F.min("id").alias("first"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = stage(classes, "knn-classes")
    route = cell_bits(classes.count(), cell)
    index = _routed(classes.select("code", "first"), route)
    large = index.groupBy("segment", "cell").count().where(F.col("count") > cell)  # a row per ``cell`` classes at most
    large = stage(large.select("segment", "cell", F.ceil(F.col("count") / cell).cast("int").alias("_parts")), "knn-large")
    parts = F.coalesce("_parts", F.lit(1))
    of = ["segment", "cell"]
    index = index.join(large, of, "left").withColumn("part", F.pmod(F.xxhash64("code"), parts).cast("int"))
    index = index.select(*of, "part", "code", F.lit(-1).alias("spare"), F.col("first").alias("extra"))
    open_ = stage(queries.select("code").distinct().withColumn("bound", F.lit(FAR)), "knn-open")
    best = None
    for radius in range(WIDTH + 1):
        turns = F.array(*[F.lit(m) for f in range(min(radius, route) + 1) for m in masks(route, f)])
        visits = _routed(open_, route).withColumn("_mask", F.explode(turns))
        visits = visits.withColumn("cell", F.col("cell").bitwiseXOR(F.col("_mask"))).join(large, of, "left")
        visits = visits.select(
            *of,
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
            "code",
            (radius - F.bit_count("_mask")).cast("int").alias("spare"),
            F.col("bound").cast("long").alias("extra"),
        )
        met = index.union(visits).repartition(*of, "part").sortWithinPartitions(*of, "part", "spare")
        new = met.mapInArrow(lambda b: _cells(b, wanted, route), "query long, code long, distance long")
        new = new.join(classes.select("code", "first", F.size("ids").alias("size")), "code").select("query", "code", "distance", "first", "size")
        pool = (new if best is None else new.unionByName(best)).distinct()
        nearest = F.row_number().over(W.partitionBy("query").orderBy("distance", "first"))
        now = stage(pool.withColumn("_rn", nearest).where(F.col("_rn") <= wanted).drop("_rn"), "knn-best")
        seen = now.groupBy("query").agg(
            F.sum(F.when(F.col("distance") <= SEGMENTS * radius + SEGMENTS - 1, F.col("size")).otherwise(0)).alias("_sure"),
            F.sum("size").alias("_have"),
            F.max("distance").alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        after = open_.join(seen, open_["code"] == seen["query"], "left").where(F.coalesce("_sure", F.lit(0)) < wanted)
        after = after.select("code", F.when(F.col("_n") >= wanted, F.col("_last")).otherwise(FAR).cast("int").alias("bound"))
        after = stage(after, "knn-open")
        for old in (best, open_):
            if old is not None:
                unstage(old)
        best, open_ = now, after
        if open_.isEmpty():
            break
    found = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(best, "query").join(classes.select("code", "ids"), "code")
    others = found.select("query_id", "distance", F.explode("ids").alias("id")).where("id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
