"""The order tables of the test data, seen as sales, stores and products.

Two grains: ``sparse`` is supplier x part, ``dense`` is nation x brand. City, state, opening year, district halves
and sub-category have no column in the test data and are made from keys.

Joins of plain tables carry no hint: their sizes are known from the files, so Spark broadcasts a side below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, with adaptive execution splitting skewed
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import QTY_TYPE
from tidemark.sources.tables import load_table

GRAINS = ("sparse", "dense")
MONEY = "decimal(18,4)"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str, grain: str = "dense") -> DataFrame:
    lines = _read(spark, folder, "lineitem")
    if grain == "sparse":
        store, product = F.col("l_suppkey"), F.col("l_partkey")
    elif grain == "dense":
        lines = lines.join(
            _read(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"
        ).join(_read(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        store, product = F.col("s_nationkey"), F.col("p_brand")
    else:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    price = F.col("l_extendedprice")
    return lines.select(
        F.col("l_shipdate").cast("date").alias("date"),
        store.alias("store_id"),
        product.alias("product_id"),
        F.col("l_quantity").cast(QTY_TYPE).alias("qty"),
        price.cast(MONEY).alias("revenue"),
        (price * F.col("l_tax")).cast(MONEY).alias("tax"),
        (price * (1 - F.col("l_discount"))).cast(MONEY).alias("cost"),
    )


def raw_text_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as an export with decimal commas would hold them: numbers as text, the day as a timestamp."""
    lines = _read(spark, folder, "lineitem")
    price = F.col("l_extendedprice")

    def comma(value, kind):
        return F.replace(value.cast(kind).cast("string"), F.lit("."), F.lit(","))

    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        comma(F.col("l_quantity"), QTY_TYPE).alias("qty"),
        comma(price, MONEY).alias("revenue"),
        comma(price * F.col("l_tax"), MONEY).alias("tax"),
        comma(price * (1 - F.col("l_discount")), MONEY).alias("cost"),
    )


def stores(spark: SparkSession, folder: str, grain: str = "dense") -> DataFrame:
    nations = _read(spark, folder, "nation").join(
        _read(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    if grain == "dense":
        key, code = F.col("n_nationkey"), F.col("n_name")
        district = F.concat("r_name", F.lit("-"), (F.col("n_nationkey") % 2).cast("string"))
    else:
        nations = nations.join(
            _read(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey"
        )
        key, code, district = F.col("s_suppkey"), F.col("s_name"), F.col("n_name")
    return nations.select(
        key.alias("store_id"),
        code.alias("store_code"),
        F.col("r_name").alias("region"),
        district.alias("district"),
        F.concat(F.lit("C"), (key % 20).cast("string")).alias("city"),
        F.substring("r_name", 1, 2).alias("state"),
        (F.lit(1990) + key % 10).cast("int").alias("opened_year"),
    )


def products(spark: SparkSession, folder: str, grain: str = "dense") -> DataFrame:
    """Products; at the dense grain only the key, since the other columns vary within a brand."""
    parts = _read(spark, folder, "part")
    if grain == "dense":
        return parts.select(F.col("p_brand").alias("product_id")).distinct()
    return parts.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("supplier"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.concat("p_type", F.lit("-"), (F.col("p_size") % 5).cast("string")).alias("sub_category"),
    )


def monthly_order_value(spark: SparkSession, folder: str) -> DataFrame:
    """A monthly outside indicator: mean order value, from the orders table."""
    day = F.col("o_orderdate").cast("date")
    return (
        _read(spark, folder, "orders")
        .groupBy(F.trunc(day, "MM").alias("month_start"))
        .agg(
            (F.sum(F.col("o_totalprice").cast(MONEY)).cast("double") / F.count("o_totalprice")).alias(
                "mean_order_value"
            )
        )
    )
