"""Mixing sources to target weights: block quotas by highest quotients, then blocks in a seeded order.

The mix is a number of blocks of equal token count. Sainte-Laguë apportionment gives each output shard an integer number
of blocks from each source: seats go to the highest quotients ``target / (2 k + 1)``. It is monotone in the number of
seats, so the seats of the first h shards contain those of the first h - 1, and a shard's quota is the difference.

A source's blocks are cut from its documents laid end to end in an order seeded by their ids. Since that order is random,
the first blocks of it are a random choice; quotas beyond the source's length go round again. A document's part then
follows from its place alone, so no block is ever a row. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.order import ordered, with_position, with_running
from tidemark.llm.places import placed
from tidemark.llm.text import word_count
from tidemark.runtime import stage, unstage, working


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, total, rank, target``: ``share`` of all sizes dealt by weight, no source above ``cap`` times its own.

    Sources in code point order, NULL last, take the weights in turn. Dealing the excess anew until no source is above
    its cap ends at ``min(cap * total, level * weight)`` with one level for all; with the sources in the order in which
    they reach their caps, the level is the largest of ``(sum - caps before) / weights from here``.
    """
    totals = ordered(
        sizes.groupBy("source").agg(F.sum("size").alias("total")), [F.col("source").isNull(), "source"], "mix-sources"
    )
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = with_position(totals, "rank").select(
        "source",
        "total",
        "rank",
        F.get(dealt, (F.col("rank") % len(weights)).cast("int")).alias("_w"),
        (F.lit(float(cap)) * F.col("total")).alias("_cap"),
    )
    filled = ordered(ranked, [F.col("_cap") / F.col("_w"), "rank"], "mix-levels")
    sums = with_running(with_running(filled, "_cap", "_caps"), "_w", "_ws")
    sum_, caps = F.lit(float(share)) * F.sum("total"), F.sum("_cap")
    whole = filled.agg(F.least(sum_, caps).alias("_t"), caps.alias("_all"), F.sum("_w").alias("_wall"))  # one row
    level = (
        sums.crossJoin(F.broadcast(whole))
        .agg(
            F.max(
                (F.col("_t") - (F.col("_caps") - F.col("_cap"))) / (F.col("_wall") - (F.col("_ws") - F.col("_w")))
            ).alias("_level")
        )
    )  # one row
    target = F.least(F.col("_cap"), F.col("_level") * F.col("_w"))
    out = filled.crossJoin(F.broadcast(level)).select("source", "total", "rank", target.alias("target"))
    out = stage(out, "mix-targets")
    unstage(filled)
    unstage(totals)
    return out


def shard_quotas(targets: DataFrame, block: int, shards: int) -> DataFrame:
    """``source, shard, quota``: how many blocks of ``block`` tokens each output shard takes from each source.

    For n sources and h seats, source i has between ``t (h - n/2) / T - 1/2`` and ``t (h + n/2) / T + 1/2`` seats, since
    every source's seats are its share by one common divisor, rounded. The lower bound is given outright; only the
    few seats up to the upper bound, about three to a source and shard, compete by quotient (ties by source order).
    """
    live = targets.where(F.col("target") > 0)
    whole = live.agg(F.sum("target").alias("_t"), F.count(F.lit(1)).alias("_n"))  # one row
    shard = F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("_upto")
    houses = live.crossJoin(F.broadcast(whole)).select("source", "rank", "target", "_t", "_n", shard)
    house = F.round(F.col("_t") / block * F.col("_upto") / shards).cast("long")
    part = lambda seats: F.col("target") * seats / F.col("_t")
    houses = houses.withColumn("_house", house).withColumns(
        {
            "_low": F.greatest(F.lit(0), F.floor(part(F.col("_house") - F.col("_n") / 2) - 0.5) - 1).cast("long"),
            "_high": F.ceil(part(F.col("_house") + F.col("_n") / 2) + 0.5).cast("long") + 1,
        }
    )
    houses = stage(houses, "mix-houses")
    given = houses.groupBy("_upto").agg((F.first("_house") - F.sum("_low")).alias("_left"), F.sum(F.col("_high") - F.col("_low")).alias("_runners"))
    before = W.orderBy("_upto").rowsBetween(W.unboundedPreceding, -1)
    given = given.select("_upto", "_left", F.coalesce(F.sum("_runners").over(before), F.lit(0)).alias("_first"))  # a row per shard
    seats = houses.select(
        "_upto", "source", "rank", "target", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k")
    ).withColumn("_quotient", F.col("target") / (2 * F.col("_k") + 1))
    seats = ordered(seats, ["_upto", F.desc("_quotient"), "rank", "_k"], "mix-seats")
    won = (
        with_position(seats, "_at")
        .join(F.broadcast(given), "_upto")
        .where(F.col("_at") - F.col("_first") < F.col("_left"))
        .groupBy("_upto", "rank")
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    held = houses.join(won, ["_upto", "rank"], "left").select(
        "source", "rank", "_upto", (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("_seats")
    )
    earlier = F.lag("_seats", 1, 0).over(W.partitionBy("rank").orderBy("_upto"))
    out = stage(held.select("source", (F.col("_upto") - 1).alias("shard"), (F.col("_seats") - earlier).alias("quota")), "mix-quotas")
    unstage(seats)
    unstage(houses)
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 64,
    shards: int = 8,
    seed: int = 20,
    carry: bool = False,
) -> DataFrame:
    """How many words the mix takes of each row of ``docs``.

    Size is the number of words of the text (NULL: 0). Returns ``doc_id, size, source_size, target, blocks, taken, shards``
    and, with ``carry``, ``row``: all input columns as a struct. A source's taken words are its blocks times ``block``, so
    within half a block of its target unless the cap ends them; a row is taken whole as often as its source goes round,
    and once more as far as the last round reaches. ``shards`` lists ``(shard, words)``: the output shards that take the row
    and how much of it, so that a shard gets its quota of blocks from each source. The order is seeded by id and text, and
    rows equal in both are interchangeable, so runs agree however the rows are dealt, NULL and repeated ids included. NULL
    sources are one source; a row without words has 0 taken; no rows give no rows. Only ids, sizes and hashes are put in
    order; with ``carry`` the rows themselves are joined to the result once.
    """
    docs_, place = placed(docs, "mix-input")
    with working() as keep:
        read = docs_.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("_digest"), F.col(place).alias("_place"))
        dice = F.xxhash64(F.lit(seed), "doc_id", "_digest")
        order = [F.col("source").isNull(), "source", "_dice", "doc_id", "_digest", "_place"]
        rows = ordered(read.withColumn("_dice", dice), order, "mix-rows")
        targets = source_targets(rows, weights, share, cap)
        quotas = shard_quotas(targets, block, shards)
        up_to = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
        blocks = quotas.withColumn("_upto", F.sum("quota").over(up_to)).groupBy("source").agg(
            F.sum("quota").alias("blocks"), F.array_sort(F.collect_list(F.struct("shard", F.col("_upto").alias("upto")))).alias("_ends")
        )
        plan = targets.join(blocks, targets["source"].eqNullSafe(blocks["source"]), "left").select(
            targets["source"].alias("_source"),
            F.col("total").alias("source_size"),
            "rank",
            "target",
            F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"),
            "_ends",
        )
        plan = ordered(plan, ["rank"], "mix-plan")
        plan = with_running(plan, "source_size", "_end").select(
            "_source", "source_size", "target", "blocks", "_ends", (F.col("_end") - F.col("source_size")).alias("_start")
        )
        plan = stage(plan, "mix-starts")
        words = F.least(F.col("blocks") * block, F.floor(cap * F.col("source_size"))).cast("long")
        low = F.col("_upto") - F.col("size") - F.col("_start")

        def within(taken: Column) -> Column:
            """Words of the row among the first ``taken`` of its source, going round."""
            round_ = F.nullif(F.col("source_size"), F.lit(0))
            rest = F.pmod(taken, round_)
            reached = F.least(F.col("_low") + F.col("size"), rest) - F.least(F.col("_low"), rest)
            return F.coalesce(F.floor(taken / round_) * F.col("size") + reached, F.lit(0))

        cut = lambda end: F.least(end["upto"] * block, F.col("_words"))
        ends = F.transform("_ends", lambda e: F.struct(e["shard"].cast("int").alias("shard"), within(cut(e)).alias("upto")))
        parts = F.transform(
            "_cuts",
            lambda e, i: F.struct(
                e["shard"].alias("shard"),
                (e["upto"] - F.when(i > 0, F.get(F.col("_cuts"), i - 1)["upto"]).otherwise(0)).cast("long").alias("words"),
            ),
        )
        joined = (
            with_running(rows, "size", "_upto")
            .join(plan, F.col("source").eqNullSafe(F.col("_source")))
            .withColumns({"_words": words, "_low": low})
            .withColumn("_cuts", ends)
            .withColumn("shards", F.coalesce(F.filter(parts, lambda p: p["words"] > 0), F.array().cast("array<struct<shard:int,words:bigint>>")))
        )
        out = joined.select("_place", "doc_id", "size", "source_size", "target", "blocks", within(F.col("_words")).cast("long").alias("taken"), "shards")
        out = keep(stage(out, "mixed"))
    if carry:
        whole = docs_.select(F.col(place).alias("_place"), F.struct(*[docs_[c] for c in docs.columns]).alias("row"))
        out = out.join(whole, "_place")
    return out.drop("_place")


def copies(taken: Column, size: Column) -> Column:
    """Whole copies of a document for the words taken of it: the nearest number, halves up, 0 if it has no words."""
    return F.when(size > 0, F.floor((2 * taken + size) / (2 * size))).otherwise(0).cast("int")
