"""URL filters whose lists change: a temporal join of captures to dated list entries.

Dated entries (a pattern is listed or taken off on a day) become validity intervals, and each capture is judged by the
entries in force on the day it was fetched. A pattern is a domain, which covers its subdomains, or a host with the start of
a path. A URL has no more keys such patterns can equal than labels and path segments, as deep as the list goes, so the
join is on the key and the month, with the day compared within: a month of a pattern has at most as many intervals as
days, however long its history, and adaptive execution may split the captures of one host. Most keys of a URL, such as its
top-level domain, are in no list: before they are written out as rows they are looked up in a bit table of the listed
patterns, whose size is fixed, so they never reach the shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
LISTED_BITS = 20  # 2 ** 20 bits, 128 KB: 1 in 10 of unlisted keys pass at 100,000 patterns, which the join then drops
DEPTH = 3  # path segments of a URL that are keys unless the list says how many it needs


def host(url: Column) -> Column:
    """The lower-cased host, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SCHEME + "(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_keys(url: Column, depth: int = DEPTH) -> Column:
    """What a pattern may equal: the host's suffixes, and the host with up to ``depth`` path segments. None without a host."""
    name = host(url)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), _SCHEME + "[^/?#]*([^?#]*)", 1)
    labels = F.split(name, "\\.")
    steps = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth)
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    paths = F.transform(steps, lambda _, i: F.concat(name, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")))
    return F.when(name != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, since, until`` (exclusive, NULL: still listed) from ``pattern, day, action`` ('add' or 'remove').

    An entry holds until the pattern's next one. Several entries of a day count as one, and as 'remove' if any says so.
    Entries with a NULL are left out; an 'add' while listed goes on as a new interval; other actions count as 'remove'.
    """
    known = entries.where("pattern IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL")
    daily = known.groupBy("pattern", "day").agg(F.max(F.col("action") != "add").alias("_off"))
    until = F.lead("day").over(W.partitionBy("pattern").orderBy("day"))  # a row per day at most
    return daily.withColumn("until", until).where(~F.col("_off")).select("pattern", F.col("day").alias("since"), "until")


def listed_only(keys: Column, patterns: DataFrame, bits: int = LISTED_BITS) -> Column:
    """The keys that may be among ``patterns.pattern``: those whose hash marks a bit that some pattern's marks."""
    slot = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - bits)
    marked = patterns.select(slot(F.col("pattern")).alias("_s")).groupBy(F.shiftright("_s", 6).cast("int").alias("word"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_s").bitwiseAND(63).cast("int"))
    words = marked.agg(F.bit_or(one).alias("value"))
    table = [0] * (1 << (bits - 6))
    for r in words.collect():  # at most as many as the table has
        table[r["word"]] = r["value"]
    held = F.from_json(F.lit(json.dumps(table)), "array<bigint>")  # folded to a literal array
    word = lambda k: F.get(held, F.shiftright(slot(k), 6).cast("int"))
    return F.filter(keys, lambda k: F.getbit(word(k), slot(k).bitwiseAND(63).cast("int")) == 1)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched, blocked, pattern, since`` of every capture (``page_id, url, fetched`` date).

    ``pattern`` is the longest one in force on the day of the fetch (ties: the first by name), ``since`` its day of
    listing; both are NULL if none is. A capture without host or date is not blocked. Rows that repeat a capture are
    each judged alike. Other columns are ignored. Paths in ``entries`` may have any number of segments.
    """
    captures = captures.select("page_id", "url", "fetched")
    depth = max(0, entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0)  # of the deepest path listed
    ends = captures.agg(F.min("fetched"), F.max("fetched")).first()
    month = lambda day: F.year(day) * 12 + F.month(day)
    first, last = (F.lit(d).cast("date") for d in ends)
    spans = validity(entries).where((F.col("since") <= last) & (F.coalesce("until", last + F.expr("INTERVAL 1 DAY")) > first))
    spans = spans.withColumn(
        "month",
        F.explode(
            F.sequence(
                F.greatest(month(F.col("since")), month(first)),
                F.least(F.coalesce(month(F.date_sub("until", 1)), month(last)), month(last)),
            )
        ),
    )
    asked = captures.where("fetched IS NOT NULL AND url IS NOT NULL").distinct()
    keys = listed_only(url_keys(F.col("url"), depth), spans)
    asked = asked.withColumns({"pattern": F.explode(keys), "month": month(F.col("fetched"))})
    met = asked.join(spans, ["pattern", "month"]).where("since <= fetched AND (until IS NULL OR fetched < until)")
    # the longest pattern, then the first by name, of each capture
    rank = F.min_by(F.struct("pattern", "since"), F.struct(-F.length("pattern"), F.col("pattern")))
    found = met.groupBy("page_id", "url", "fetched").agg(rank.alias("_hit"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in captures.columns], "_hit")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in captures.columns]
    return captures.join(found, same, "left").select(
        *captures.columns,
        F.col("_hit").isNotNull().alias("blocked"),
        F.col("_hit.pattern").alias("pattern"),
        F.col("_hit.since").alias("since"),
    )
