"""Writers. Every partition writes its own file; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_forecast(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", newest_first: bool = True
) -> None:
    """Write a forecast as CSV (with header) or parquet, newest date first across the part files."""
    if newest_first:
        ids = [c for c in ("store_id", "product_id") if c in df.columns]
        df = df.orderBy(F.desc("date"), *ids)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")


def read_forecast_csv(spark, path: str, schema: str) -> DataFrame:
    """Read a written CSV forecast with a stated schema, so no inference pass over the files is needed."""
    return spark.read.schema(schema).option("header", True).csv(path)
