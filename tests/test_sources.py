import contextlib
import datetime as dt
import io
from decimal import Decimal

import pytest

from tidemark import runtime
from tidemark.plans import forecast
from tidemark.sources import tables

SCHEMA = "date date, store_id int, product_id int, qty decimal(12,2), revenue double, tax double, cost double"


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (dt.date(2018, 1, 1) + dt.timedelta(days=i), i % 3, i % 5, Decimal(i % 7), 1.0, 0.1, 0.5) for i in range(700)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plan_text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_catalog_and_path(spark, sales, tmp_path):
    sales.createOrReplaceTempView("sold_items")
    assert tables.load_sales(spark, "sold_items").count() == 700
    path = str(tmp_path / "sales")
    sales.withColumnRenamed("qty", "units").write.parquet(path)
    assert tables.load_sales(spark, path, {"units": "qty"}).count() == 700
    with pytest.raises(ValueError, match="qty"):
        tables.load_sales(spark, path)


def test_donor_filter_reaches_the_scan(spark, sales, tmp_path):
    """With a date column the donor months prune partitions, or row groups of an unpartitioned table."""
    stores, products = sales.select("store_id").distinct(), sales.select("product_id").distinct()
    flat, parted = str(tmp_path / "flat"), str(tmp_path / "parted")
    sales.write.parquet(flat)
    sales.coalesce(1).write.partitionBy("date").parquet(parted)
    last = dt.date(2019, 12, 1)
    signs = {flat: "GreaterThanOrEqual(date,", parted: "PartitionFilters: [isnotnull(date"}
    for path, sign in signs.items():
        source = spark.read.parquet(path)
        known = forecast.forecast_daily(source, stores, products, last_date=last)
        assert sign in plan_text(known)
        looked_up = forecast.forecast_daily(source, stores, products)
        assert looked_up.exceptAll(known).count() == 0 and looked_up.count() == known.count() > 0
    # the partition filter stands as well where the plan itself finds the last date
    read = forecast.forecast_daily(spark.read.parquet(parted), stores, products)
    assert signs[parted] in plan_text(read)


def test_only_needed_columns_are_read(spark, sales, tmp_path):
    path = str(tmp_path / "wide")
    sales.write.parquet(path)
    stores = spark.createDataFrame([(0,), (1,)], "store_id int")
    products = spark.createDataFrame([(0,), (1,)], "product_id int")
    text = plan_text(forecast.forecast_daily(spark.read.parquet(path), stores, products))
    assert "ReadSchema: struct<date:date,store_id:int,product_id:int,qty:decimal(12,2)>" in text
    assert "revenue" not in text and "tax" not in text and "cost" not in text


def test_staged_and_frozen_rows(spark, sales):
    assert runtime.stage(sales, "t").exceptAll(sales).count() == 0
    assert runtime.freeze(sales).count() == 700
    assert runtime.checkpoint_root(spark)
    # the frozen plan no longer depends on its source
    assert "LocalTableScan" not in plan_text(runtime.freeze(sales))
