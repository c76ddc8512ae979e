"""Sharding by minimax contiguous partition: the smallest shard capacity that a greedy fill can keep.

Atomic groups (rows with equal texts) lie in one order and are cut into contiguous shards so that the largest shard is as
small as any such cut can make it. The capacity is found by binary search, several halvings to a round: a round tests
``PROBES`` evenly spaced capacities at once, and a greedy step of all of them is one aggregate over the written running
totals, bounded to the stretch where the next cuts can lie. The driver holds capacities and cuts, never groups.

Everything is DataFrame expressions; no group of equal texts is ever gathered, since the order's last key is a mark of the
row itself, and only sizes and digests are put in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.order import ordered, with_position, with_running
from tidemark.llm.places import placed
from tidemark.runtime import stage, unstage, working

PROBES = 31


@dataclass(frozen=True)
class Cuts:
    """``capacity``: the least feasible one; ``ends``: running total at the end of each shard (repeats if one is empty)."""

    total: int
    capacity: int
    ends: tuple[int, ...]


def _last_at_most(totals: DataFrame, targets: list[int], widest: int) -> list[int]:
    """For each target the largest group end that does not exceed it (0 if none)."""
    near = totals.where((F.col("upto") > min(targets) - widest) & (F.col("upto") <= max(targets)))
    row = near.agg(*[F.max(F.when(F.col("upto") <= t, F.col("upto"))).alias(f"m{i}") for i, t in enumerate(targets)]).first()
    return [x or 0 for x in row]


def _first_at_least(totals: DataFrame, target: int, widest: int) -> int:
    if target <= 0:
        return 0
    near = totals.where((F.col("upto") >= target) & (F.col("upto") < target + widest))
    return near.agg(F.min("upto")).first()[0]


def minimax_cuts(totals: DataFrame, shards: int) -> Cuts:
    """Cut groups with running totals ``upto`` and sizes ``size`` (at least 1) into ``shards`` contiguous shards.

    The capacity is the least for which a greedy fill needs no more than ``shards`` shards. The cuts keep to it and,
    within it, each lies as near as it can to an even share of what is left, so that a large group does not leave later
    shards empty. No groups: all ends are 0.
    """
    total, widest = totals.agg(F.max("upto"), F.max("size")).first()
    if total is None:
        return Cuts(0, 0, (0,) * shards)
    even = -(-total // shards)
    low, high = max(even, widest), max(even, widest) + widest  # high is always feasible: a fill leaves less than a group
    while low < high:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        tried = list(range(low, high, step))
        ends = [0] * len(tried)
        for _ in range(shards):
            open_ = [i for i, e in enumerate(ends) if e < total]
            if not open_:
                break
            found = _last_at_most(totals, [ends[i] + tried[i] for i in open_], widest)
            for i, e in zip(open_, found, strict=True):
                ends[i] = e
        fits = [c for c, e in zip(tried, ends, strict=True) if e == total]
        short = [c for c, e in zip(tried, ends, strict=True) if e < total]
        low, high = (max(short) + 1 if short else low), (min(fits) if fits else high)
    return Cuts(total, low, _even_cuts(totals, shards, total, low, widest))


def _even_cuts(totals: DataFrame, shards: int, total: int, capacity: int, widest: int) -> tuple[int, ...]:
    earliest = [total]  # from the end: how early each cut may lie so that what follows still fits
    for _ in range(shards - 1):
        earliest.append(_first_at_least(totals, earliest[-1] - capacity, widest))
    earliest.reverse()
    ends, at = [], 0
    for s in range(shards - 1):
        ideal = at + (total - at) // (shards - s)
        below, most = _last_at_most(totals, [ideal, at + capacity], widest)
        above = _first_at_least(totals, ideal, widest)
        near = below if ideal - below <= above - ideal and below > at else above
        at = min(max(near, earliest[s]), max(most, at))
        ends.append(at)
    return (*ends, total)


def shard_documents(docs: DataFrame, shards: int = 8, carry: bool = False) -> DataFrame:
    """Each row's shard and slot, by law ``bytes``: shard sizes as even as groups of equal texts allow.

    Size is the text's UTF-8 bytes plus 1; a NULL text has none and goes with the empty ones. Groups are ordered by the
    SHA-256 of their text, rows of a group by ``doc_id`` and then where they lie, so a shard is a range of that order, and
    slots count from 0 within it. Returns ``doc_id, size, text_crc32, law, shard, slot`` and, with ``carry``, ``row``: all
    columns of the input as a struct, so that columns named alike do not clash. NULL ids sort first; repeated rows each get a slot;
    rows that are equal in id and text are interchangeable. No rows give no rows; fewer groups than shards leave
    shards empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    wanted = [
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("_group"),
    ]
    docs_, place = placed(docs, "shard-input")
    with working() as keep:
        rows = ordered(docs_.select(*wanted, F.col(place).alias("_place")), ["_group", "doc_id", "_place"], "shard-rows")
        groups = ordered(rows.groupBy("_group").agg(F.sum("size").alias("size")), ["_group"], "shard-groups")
        totals = stage(with_running(groups, "size").select("_group", "size", "upto"), "shard-totals", sort=["upto"])
        cuts = minimax_cuts(totals, shards)
        last = {r["upto"]: r["_group"] for r in totals.where(F.col("upto").isin(list(set(cuts.ends)))).collect()}  # at most `shards`
        unstage(groups)
        unstage(totals)
        lowest = F.lit(0)
        for end in cuts.ends[:-1]:
            lowest = lowest + (F.col("_group") > F.lit(bytes(last[end]))).cast("int") if end in last else lowest + 1
        numbered = with_position(rows).withColumn("shard", lowest)
        starts = numbered.groupBy("shard").agg(F.min("position").alias("_start"))  # at most `shards` rows
        out = numbered.join(F.broadcast(starts), "shard").select(
            "_place",
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("position") - F.col("_start")).alias("slot"),
        )
        out = keep(stage(out, "sharded"))
    if carry:
        whole = docs_.select(F.col(place).alias("_place"), F.struct(*[docs_[c] for c in docs.columns]).alias("row"))
        out = out.join(whole, "_place")
    return out.drop("_place")
