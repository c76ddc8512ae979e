"""Readers for the sales fact and its dimensions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SALES_COLUMNS = ("date", "store_id", "product_id", "qty", "revenue", "tax", "cost")
STORE_COLUMNS = ("store_id", "store_code", "region", "district", "city", "state", "opened_year")
PRODUCT_COLUMNS = ("product_id", "supplier", "product_name", "category", "sub_category")


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; found {df.columns}")
    return df


def load_table(
    spark: SparkSession,
    source: str,
    rename: dict[str, str] | None = None,
    required: Iterable[str] = (),
) -> DataFrame:
    """Read a catalog table, or parquet files where ``source`` is a path, under our column names.

    ``rename`` maps source columns to ours. Dimensions that carry no further columns (channels, business units) are
    read with this alone.
    """
    is_path = "/" in source or source.endswith(".parquet")
    df = spark.read.parquet(source) if is_path else spark.read.table(source)
    if rename:
        df = df.withColumnsRenamed(rename)
    return require_columns(df, required, source)


def load_sales(spark: SparkSession, source: str, rename: dict[str, str] | None = None) -> DataFrame:
    return load_table(spark, source, rename, SALES_COLUMNS)


def load_stores(spark: SparkSession, source: str, rename: dict[str, str] | None = None) -> DataFrame:
    return load_table(spark, source, rename, STORE_COLUMNS)


def load_products(spark: SparkSession, source: str, rename: dict[str, str] | None = None) -> DataFrame:
    return load_table(spark, source, rename, PRODUCT_COLUMNS)
