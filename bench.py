"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Each query runs once untimed and
its time is that of the second run, with every row produced and none kept; long ones run once. ``comparisons``
sets the plans used here beside the direct ways of writing the same step: [direct seconds, our seconds].
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml.feature import StandardScaler, VectorAssembler  # noqa: E402
from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.functions.dates import date_parts  # noqa: E402
from tidemark.operators import panel, series, split  # noqa: E402
from tidemark.operators.features import unit_scaler  # noqa: E402
from tidemark.plans import forecast  # noqa: E402
from tidemark.registry.queries import QUERIES  # noqa: E402
from tidemark.runtime import local_session, stage  # noqa: E402
from tidemark.sources import standin  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "clean_decimal_comma",
    "null_audit",
    "monthly_sales",
    "monthly_sales_by_store",
    "daily_panel",
    "enriched_panel",
    "decompose_monthly",
    "decompose_by_store",
    "autocorrelation_daily",
    "autocorrelation_by_store",
    "correlation_matrix",
    "correlation_wide",
    "category_index_product",
    "onehot_product",
    "scaled_features",
    "chrono_split",
    "baseline_fit",
    "baseline_fit_one_shuffle",
    "baseline_train_predictions",
    "baseline_rmse",
    "baseline_rmse_seasonal",
    "lr_single_feature",
    "linear_rmse",
    "forest_rmse",
    "forest_indexed_rmse",
    "model_comparison",
    "rolling_linear_category_scores",
    "horizon_models",
    "autoregressive_forecast",
    "autoregressive_forecast_by_store",
    "forecast_cells",
    "forecast_daily_by_product",
    "forecast_daily_by_store",
    "forecast_horizons_by_product",
    "forecast_csv_round_trip",
    "lag_features",
    "calendar_lag_features",
    "rolling_scores",
    "calendar_join",
]
# long enough that one run is a fair measure
ONCE = {"forest_rmse", "forest_indexed_rmse", "model_comparison", "rolling_linear_category_scores"}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def clock(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def comparisons(spark) -> dict[str, list[float]]:
    sales = stage(standin.sales(spark, FOLDER), "bench-sales")
    rows = panel.daily_panel(sales)
    stores = standin.stores(spark, FOLDER)

    def split_by_rank():
        run(rows.withColumn("r", F.percent_rank().over(Window.orderBy("date"))).where("r <= 0.8"))

    def split_by_cutoff():
        run(split.flag_split(rows).where("is_train"))

    # nations x parts, a grid with 25 cells for each row of the roll-up
    suppliers = spark.read.parquet(f"{FOLDER}/supplier.parquet")
    nation = suppliers.select(F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").alias("nation"))
    by_part = standin.sales(spark, FOLDER, "sparse").join(nation, "store_id").drop("store_id")
    by_part = stage(by_part.withColumnRenamed("nation", "store_id"), "bench-sales-by-part")
    parts = standin.products(spark, FOLDER, "sparse")

    def forecast_over_grid():
        run(forecast.forecast_cells(by_part, stores, parts).groupBy("date", "product_id").agg(F.sum("prediction")))

    def forecast_summed_first():
        run(forecast.forecast_daily(by_part, stores, parts))

    names = list(date_parts(F.col("date")))
    dated = stage(rows.withColumns(date_parts(F.col("date"))).select("date", *names), "bench-dated")

    def scaler_per_column():
        for n in names:
            one = VectorAssembler(inputCols=[n], outputCol="v").transform(dated)
            StandardScaler(inputCol="v", outputCol="s").fit(one)

    def one_scaler():
        unit_scaler("v").fit(VectorAssembler(inputCols=names, outputCol="v").transform(dated))

    days = panel.daily_totals(sales, ["store_id"])

    def lags_by_pairs():
        order = Window.partitionBy("store_id").orderBy("date")
        z = days.select("store_id", F.row_number().over(order).alias("i"), F.col("qty").cast("double").alias("y"))
        b = z.select("store_id", F.col("i").alias("j"), F.col("y").alias("u"))
        run(
            z.join(b, "store_id")
            .where("j > i AND j <= i + 550")
            .groupBy("store_id", F.expr("j - i").alias("lag"))
            .agg(F.sum(F.col("y") * F.col("u")))
        )

    def lags_by_blocks():
        run(series.autocorrelation(days, ["store_id"], on_gap="row"))

    pairs = {
        "split: rank window vs cutoff": (split_by_rank, split_by_cutoff),
        "forecast: full grid vs summed first": (forecast_over_grid, forecast_summed_first),
        "scaling: fit per column vs one fit": (scaler_per_column, one_scaler),
        "autocorrelation: row pairs vs blocks": (lags_by_pairs, lags_by_blocks),
    }
    out = {}
    for name, (direct, ours) in pairs.items():
        direct(), ours()
        out[name] = [clock(direct), clock(ours)]
    return out


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS), app="bench")
    times = {}
    for name in HEADLINE:
        query = QUERIES[name]
        if name not in ONCE:
            run(query(spark, FOLDER))
        times[name] = clock(lambda: run(query(spark, FOLDER)))
        print(f"{name:34s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    result = {
        "metric": "total seconds, headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "comparisons": comparisons(spark),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
