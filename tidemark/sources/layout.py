"""Tables laid out by their keys, so that later plans need no exchange.

A bucketed table is dealt by a hash of its keys into a fixed number of files groups, sorted within each. Aggregates, windows
and joins by those keys, or by them and more, then read every group where it lies. The panel and its fit are used by
(store, product) again and again: by the baseline's window, by the join of a fit, by lags.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.runtime import scratch_path, session_options

SERIES_KEYS = ("store_id", "product_id")
ROWS_PER_BUCKET = 2_000_000


def bucket_count(n_rows: int, rows: int = ROWS_PER_BUCKET, least: int = 8) -> int:
    """A power of two, so that tables of unlike sizes still divide each other's buckets."""
    n = least
    while n * rows < n_rows:
        n *= 2
    return n


def bucketed(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEYS,
    sort: Sequence[str] = ("date",),
    buckets: int | None = None,
    name: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """``df`` written as a bucketed, sorted parquet table of the catalog and read back.

    ``buckets``: by default from the number of rows, which are counted first. Rows are dealt to the buckets before they are
    written, so each bucket is one file. ``path``: by default the shared scratch folder; ``name``: by default a fresh one.
    """
    spark = df.sparkSession
    buckets = buckets or bucket_count(df.count())
    name, path = name or f"bucketed_{uuid.uuid4().hex}", path or scratch_path(spark, "bucketed")
    order = [*keys, *[c for c in sort if c in df.columns and c not in keys]]
    writer = df.repartition(buckets, *keys).write.format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*order).saveAsTable(name)
    return spark.table(name)


@contextmanager
def as_laid_out(spark: SparkSession) -> Iterator[None]:
    """Plans made and run in the block join bucketed tables on their keys and more without an exchange.

    Spark otherwise shuffles both sides of such a join again, unless the bucket keys are all of its keys.
    """
    with session_options(spark, spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__sources__bucketing__autoBucketedScan__enabled="false"):
        yield
