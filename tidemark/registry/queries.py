"""The named queries. Each takes (spark, folder of the test tables) and returns a DataFrame over whole tables.

Decimals, which are exact, are shown as doubles. Doubles are rounded to six places at the end, since a sum's last bits
depend on the order of its terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import date_parts, month_end, month_label, month_start, years_open
from tidemark.functions.numbers import rounded
from tidemark.operators import binning, cleaning, encoders, features, indexing, lags, panel, series, split, stats
from tidemark.plans import baseline, forecast, least_squares, refresh, regressors, validation
from tidemark.runtime import scratch_path, session_options, stage, working
from tidemark.sources import layout, sinks, standin
from tidemark.sources.tables import load_table

AS_OF_YEAR = 2002
MODEL_MEASURES = ["qty", "revenue", "tax", "cost"]
MEASURE_TYPES = {"qty": "decimal(12,2)", "revenue": "decimal(18,4)", "tax": "decimal(18,4)", "cost": "decimal(18,4)"}


def _out(df: DataFrame, *doubles: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def plain(c):
        return F.col(c).cast("double") if kinds[c].startswith("decimal") else rounded(F.col(c))

    return df.withColumns({c: plain(c) for c in doubles})


def _trio(spark, folder, grain="dense"):
    return (
        standin.sales(spark, folder, grain),
        standin.stores(spark, folder, grain),
        standin.products(spark, folder, grain),
    )


def _dense_panel(spark, folder):
    return panel.daily_panel(standin.sales(spark, folder))


def _staged_panel(spark, folder):
    return panel.staged_panel(standin.sales(spark, folder))


# -- sources, cleaning -----------------------------------------------------------------------------------------


def sales_rows(spark, folder):
    return _out(standin.sales(spark, folder, "sparse"), *MODEL_MEASURES)


def store_rows(spark, folder):
    return standin.stores(spark, folder, "sparse")


def product_rows(spark, folder):
    return standin.products(spark, folder, "sparse")


def plain_dimension(spark, folder):
    return load_table(spark, f"{folder}/nation.parquet", {"n_nationkey": "unit_id", "n_name": "unit_name"}).select(
        "unit_id", "unit_name"
    )


def calendar_days(spark, folder):
    sales = standin.sales(spark, folder, "sparse")
    return sales.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("date")
    )


def clean_decimal_comma(spark, folder):
    raw = standin.raw_text_sales(spark, folder)
    return _out(cleaning.clean_sales(raw, to=MEASURE_TYPES), *MODEL_MEASURES)


def clean_default_types(spark, folder):
    """Three and four decimals come through the default types whole."""
    return _out(cleaning.clean_sales(standin.raw_text_sales(spark, folder)), *MODEL_MEASURES)


def parse_audit(spark, folder):
    """What two-digit decimals would lose of the exported numbers."""
    return cleaning.parse_audit(standin.raw_text_sales(spark, folder), to="decimal(12,2)")


def _write_cleaned(spark, folder):
    return cleaning.write_cleaned(standin.raw_text_sales(spark, folder), scratch_path(spark, "cleaned"), to="decimal(12,2)")


def audited_write(spark, folder):
    """The same audit, counted while the cleaned rows are written."""
    audit = _write_cleaned(spark, folder)[2]
    return audit.where("column != 'date'").select("column", "n_text", "n_null_after", "n_digits_lost")


def accepted_rows(spark, folder):
    """Rows whose numbers all have two digits at most; the others are kept apart as they came."""
    accepted, rejected, _ = _write_cleaned(spark, folder)
    out = accepted.withColumn("accepted", F.lit(True)).select("l_orderkey", "l_linenumber", "accepted")
    return out.union(rejected.select("l_orderkey", "l_linenumber", F.lit(False)))


def null_audit(spark, folder):
    return cleaning.null_audit(standin.sales(spark, folder, "sparse"))


def complete_rows(spark, folder):
    """Rows left after dropping incomplete ones; labels are joined in so that some are."""
    docs = load_table(spark, f"{folder}/documents.parquet").select("doc_id", "lang", "n_chars")
    labels = load_table(spark, f"{folder}/labels.parquet")
    return cleaning.drop_incomplete(docs.join(labels, "doc_id", "left")).select("doc_id", "lang", "quality")


def row_counts(spark, folder):
    sales = standin.sales(spark, folder)
    n_panel = panel.daily_panel(sales).agg(F.count("*")).scalar()
    return sales.agg(F.count("*").alias("n_sales")).withColumn("n_panel", n_panel)


# -- dates -----------------------------------------------------------------------------------------------------


def date_features(spark, folder):
    days = standin.sales(spark, folder, "sparse").select("date").distinct()
    return days.withColumns(date_parts(F.col("date")))


def month_keys(spark, folder):
    day = F.col("date")
    return (
        standin.sales(spark, folder, "sparse")
        .groupBy(month_start(day).alias("month_start"))
        .agg(F.count("*").alias("n"))
        .select(
            "month_start",
            month_end(F.col("month_start")).alias("month_end"),
            month_label(F.col("month_start")).alias("label"),
            month_label(F.col("month_start"), padded=False).alias("short_label"),
            "n",
        )
    )


# -- totals, joins ---------------------------------------------------------------------------------------------


def monthly_sales(spark, folder):
    sales = standin.sales(spark, folder, "sparse")
    return _out(panel.monthly_totals(sales, measures=["qty", "revenue"]), "qty", "revenue")


def monthly_sales_by_store(spark, folder):
    sales, stores, _ = _trio(spark, folder)
    return _out(panel.monthly_store_totals(sales, stores), "qty")


def daily_sales(spark, folder):
    return _out(panel.daily_totals(standin.sales(spark, folder, "sparse")), "qty")


def daily_panel(spark, folder):
    return _out(_dense_panel(spark, folder), "qty")


def enriched_panel(spark, folder):
    sales, stores, products = _trio(spark, folder, "sparse")
    return _out(panel.enrich(panel.daily_panel(sales), stores, products, AS_OF_YEAR), "qty")


def store_age(spark, folder):
    stores = standin.stores(spark, folder, "sparse")
    return stores.select("store_id", years_open("opened_year", AS_OF_YEAR).alias("years_open"))


def distinct_dimensions(spark, folder):
    sales = standin.sales(spark, folder)
    return sales.select("store_id", "product_id").distinct()


def distinct_keys(spark, folder):
    """The distinct stores and products of the two dimensions, as forecasts use them."""
    _, stores, products = _trio(spark, folder, "sparse")
    keys = stores.select(F.lit("store").alias("dimension"), F.col("store_id").alias("id")).distinct()
    return keys.union(products.select(F.lit("product"), "product_id").distinct())


# -- series ----------------------------------------------------------------------------------------------------


DECOMPOSED = ("qty", "trend", "seasonal", "resid")


def decompose_monthly(spark, folder):
    months = panel.monthly_totals(standin.sales(spark, folder, "sparse"))
    return _out(series.decompose(months), *DECOMPOSED)


def decompose_additive(spark, folder):
    months = panel.monthly_totals(standin.sales(spark, folder, "sparse"))
    return _out(series.decompose(months, model="additive"), *DECOMPOSED)


def decompose_by_store(spark, folder):
    months = panel.monthly_totals(standin.sales(spark, folder), ["store_id"])
    return _out(series.decompose(months, ["store_id"], on_refused="drop"), *DECOMPOSED)


def decompose_by_store_issues(spark, folder):
    """How many of the series of ``decompose_by_store`` are taken (issue NULL) and how many refused, by reason."""
    months = panel.monthly_totals(standin.sales(spark, folder), ["store_id"])
    refused = series.series_issues(months, ["store_id"])
    every = months.select("store_id").distinct().join(refused, "store_id", "left")
    return every.groupBy("issue").agg(F.count("*").alias("n_series"))


def decompose_refused(spark, folder):
    keys = ["store_id", "product_id"]
    months = panel.monthly_totals(panel.by_series(standin.sales(spark, folder, "sparse"), keys), keys)
    return series.series_issues(months, keys).groupBy("issue").agg(F.count("*").alias("n_series"))


def autocorrelation_daily(spark, folder):
    days = panel.daily_totals(standin.sales(spark, folder, "sparse"))
    return _out(series.autocorrelation(days, on_gap="zero"), "r", "band_95", "band_99")


def autocorrelation_by_store(spark, folder):
    days = panel.daily_totals(standin.sales(spark, folder), ["store_id"])
    return _out(series.autocorrelation(days, ["store_id"], max_lag=60, on_gap="zero"), "r", "band_95", "band_99")


# -- correlation -----------------------------------------------------------------------------------------------


def correlation_matrix(spark, folder):
    return _out(stats.correlation_matrix(standin.sales(spark, folder, "sparse"), MODEL_MEASURES), "corr")


def collinear_pairs(spark, folder):
    matrix = stats.correlation_matrix(standin.sales(spark, folder, "sparse"), MODEL_MEASURES)
    return _out(stats.collinear_pairs(matrix, 0.5), "corr")


def _wide_rows(spark, folder):
    sales = standin.sales(spark, folder, "sparse")
    return sales.withColumns(date_parts(F.col("date")))


def correlation_wide(spark, folder):
    """Measures and date parts, by the matrix product that takes hundreds of columns."""
    names = [*MODEL_MEASURES, *features.DATE_PART_NAMES]
    return _out(stats.wide_correlation(_wide_rows(spark, folder), names), "corr")


def variance_inflation(spark, folder):
    """Revenue, tax and what is left of the revenue, each against those kept before it."""
    names = ["qty", "revenue", "cost"]
    matrix = stats.wide_correlation(_wide_rows(spark, folder), names)
    return _out(stats.variance_inflation(matrix, names, most=5.0), "inflation")


# -- features --------------------------------------------------------------------------------------------------


def category_index_store(spark, folder):
    return indexing.category_index(standin.stores(spark, folder, "sparse"), features.STORE_CATEGORIES)


def category_index_product(spark, folder):
    return indexing.category_index(standin.products(spark, folder, "sparse"), features.PRODUCT_CATEGORIES)


def onehot_store(spark, folder):
    return indexing.one_hot_slots(standin.stores(spark, folder, "sparse"), "store_id", features.STORE_CATEGORIES)


def onehot_product(spark, folder):
    """Slots read back from the fitted encoder's vectors, so this checks the vectors themselves."""
    encoded, usable = features.encode(standin.products(spark, folder, "sparse"), features.PRODUCT_CATEGORIES)
    slots = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.nullif(F.array_position(vector_to_array(features.vector_name(c)), F.lit(1.0)), F.lit(0)).alias("at"),
            )
            for c in usable
        ]
    )
    return encoded.select("product_id", F.inline(slots)).select("product_id", "feature", (F.col("at") - 1).alias("slot"))


def encoder_slots(spark, folder):
    """The table encoder fitted on the products of the train rows, saved, loaded and applied to all products: those with a
    value that no train row has take the slot after the last."""
    sales, _, products = _trio(spark, folder, "sparse")
    known = split.flag_split(panel.daily_panel(sales)).where("is_train").select("product_id").distinct()
    with working() as keep:
        fitted = encoders.fit_index(products.join(known, "product_id", "left_semi"), features.PRODUCT_CATEGORIES, "keep")
        path = scratch_path(spark, "encoder")
        fitted.write().save(path)
        rows = encoders.TableEncoder.load(path).transform(products)
        slots = [F.struct(F.lit(c).alias("feature"), F.col(features.index_name(c)).cast("long").alias("slot")) for c in features.PRODUCT_CATEGORIES]
        return keep(stage(rows.select("product_id", F.inline(F.array(*slots))), "encoder-slots"))


def category_bins(spark, folder):
    """Product and store categories of the train rows in 16 bins by mean quantity."""
    sales, stores, products = _trio(spark, folder, "sparse")
    train = split.flag_split(panel.daily_panel(sales)).where("is_train")
    rows = train.join(stores, "store_id").join(products, "product_id")
    means = binning.category_means(rows, [*features.STORE_CATEGORIES, *features.PRODUCT_CATEGORIES], "qty")
    return _out(binning.target_bins(means, 16), "mean")


def scaled_features(spark, folder):
    """Scaling fitted on the train rows, as the models use it."""
    flagged = split.flag_split(_staged_panel(spark, folder)).withColumns(date_parts(F.col("date")))
    names = ["year", "month", "day_of_week"]
    scaled = features.scale_columns(flagged, names, flagged.where("is_train"))
    keep = [f"{n}_scaled" for n in names]
    return _out(scaled.select("date", "store_id", "product_id", *keep), *keep)


def hashed_features(spark, folder):
    products = standin.products(spark, folder, "sparse")
    hashed = features.hash_categories(products, ["supplier", "product_name", "sub_category"], width=32)
    return hashed.select("product_id", vector_to_array("hashed_vec").alias("hashed"))


def hashed_feature_sums(spark, folder):
    """Whatever the hash: each row's vector adds up to its number of columns, and equal rows have equal vectors. With enough
    slots no two values share one (``n_alike_...``: values with the same vector)."""
    names = ["supplier", "sub_category"]
    products = standin.products(spark, folder, "sparse")
    hashed = features.hash_categories(products, names, width=32).select(*names, vector_to_array("hashed_vec").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    rows = hashed.groupBy(*names).agg(F.max(total).alias("total"), F.count_distinct("v").alias("n_vectors"))
    for c in names:
        values = features.hash_categories(products.select(c).distinct(), [c], width=4096)
        alike = values.groupBy(vector_to_array("hashed_vec").alias("v")).agg(F.collect_set(c).alias("_values"))
        alike = alike.select(F.explode("_values").alias(c), F.size("_values").cast("long").alias(f"n_alike_{c}"))
        rows = rows.join(alike, c)
    return rows.select(*names, "total", "n_vectors", *[f"n_alike_{c}" for c in names])


# -- split and baseline ----------------------------------------------------------------------------------------


def split_cutoff(spark, folder):
    return split.split_cutoff(_dense_panel(spark, folder))


def chrono_split(spark, folder):
    train, test = split.chrono_split(_staged_panel(spark, folder))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return _out(both, "qty")


def baseline_fit(spark, folder):
    return _out(baseline.fit_panel(_dense_panel(spark, folder)).drop("month_start"), "prediction")


def _refreshed(spark, folder):
    """The tables of the train days, the last 30 of them wrong, brought up to date with those days and all later ones."""
    sales = standin.sales(spark, folder)
    cutoff = split.split_cutoff(panel.daily_panel(sales)).first().cutoff
    wrong = F.col("date") > F.date_sub(F.lit(cutoff), 30)
    known = sales.where(F.col("date") <= F.lit(cutoff))
    path = scratch_path(spark, "refreshed")
    refresh.create(known.withColumn("qty", F.when(wrong, 2 * F.col("qty")).otherwise(F.col("qty")).cast("decimal(12,2)")), path)
    refresh.refresh(sales.where(wrong), path)
    return path


def panel_refreshed(spark, folder):
    return _out(refresh.panel(spark, _refreshed(spark, folder)), "qty")


def fit_refreshed(spark, folder):
    return _out(refresh.fit(spark, _refreshed(spark, folder)).drop("month_start"), "prediction")


def baseline_fit_one_shuffle(spark, folder):
    return _out(baseline.fit_sales(standin.sales(spark, folder)), "prediction")


def _scored(spark, folder, part, key="year_month"):
    scored = baseline.predictions(_dense_panel(spark, folder), key=key)
    rows = scored.where(F.col("is_train") if part == "train" else ~F.col("is_train")).where("matched")
    return _out(rows.select("date", "store_id", "product_id", "qty", "prediction"), "qty", "prediction")


def baseline_train_predictions(spark, folder):
    return _scored(spark, folder, "train")


def baseline_test_predictions(spark, folder):
    return _scored(spark, folder, "test")


def baseline_rmse(spark, folder):
    return _out(baseline.scores(baseline.predictions(_dense_panel(spark, folder))), "rmse", "coverage")


def baseline_rmse_seasonal(spark, folder):
    scored = baseline.predictions(_dense_panel(spark, folder), key="seasonal")
    return _out(baseline.scores(scored), "rmse", "coverage")


def baseline_apply_fit(spark, folder):
    """A fit table of the train rows joined to the test rows."""
    flagged = split.flag_split(_staged_panel(spark, folder))
    fit = baseline.fit_panel(flagged.where("is_train"))
    test = flagged.where("NOT is_train").select("date", "store_id", "product_id", "qty")
    return _out(baseline.apply_fit(test, fit, "seasonal", "inner"), "qty", "prediction")


# -- regressors ------------------------------------------------------------------------------------------------


def lr_single_feature(spark, folder):
    """Daily total quantity against the day number, by the linear-regression estimator."""
    days = stage(panel.daily_totals(standin.sales(spark, folder, "sparse")), "days")
    first = days.agg(F.min("date").alias("d")).scalar()
    days = days.select(
        "date", F.datediff("date", first).cast("double").alias("day_no"), F.col("qty").cast("double").alias("qty")
    )
    rows = VectorAssembler(inputCols=["day_no"], outputCol="features").transform(days)
    fitted = regressors.linear(solver="normal").fit(rows)
    return _out(fitted.transform(rows).select("date", "qty", F.col("linear").alias("prediction")), "qty", "prediction")


def _errors(spark, folder, work, *args):
    sales, stores, products = _trio(spark, folder, "sparse")
    with working() as keep:
        flagged = stage(split.flag_split(panel.daily_panel(sales)), "panel")
        return _out(keep(work(flagged, stores, products, *args, as_of_year=AS_OF_YEAR)), "rmse")


def linear_rmse(spark, folder):
    """Least squares on all features, from sums by category."""
    return _errors(spark, folder, least_squares.linear_errors)


def linear_vectors_rmse(spark, folder):
    """The same model by iteration over feature vectors."""
    return _errors(spark, folder, regressors.regressor_errors, [regressors.linear()])


def forest_rmse(spark, folder):
    """Wide categories in bins by mean target."""
    return _errors(spark, folder, regressors.regressor_errors, [regressors.indexed_forest("forest")])


def forest_indexed_rmse(spark, folder):
    """Categories of up to 256 values by index, wider ones in 256 bins."""
    spec = features.FeatureSpec(tree_width=256, tree_bins=256)
    return _errors(spark, folder, regressors.regressor_errors, [regressors.indexed_forest()], spec)


def assembled_vector_sums(spark, folder):
    """What the assembled one-hot vectors of the train rows add up to, by the name of each slot."""
    sales, stores, products = _trio(spark, folder, "sparse")
    with working() as keep:
        flagged = stage(split.flag_split(panel.daily_panel(sales)).where("is_train"), "panel")
        spec = features.FeatureSpec()
        trained = regressors.train(flagged, stores, products, [regressors.linear().setMaxIter(1)], spec, AS_OF_YEAR)
        sums = regressors.vector_sums(trained.table, "features_raw")
        names = regressors.slot_names(trained.pipeline.stages, spec)
        totals = sums.join(names, "slot", "full").select("name", F.coalesce("total", F.lit(0.0)).alias("total"))
        return _out(keep(stage(totals, "vector-sums")), "total")


MONTH_SPEC = features.FeatureSpec(numeric=("month",), store_categories=(), product_categories=())


def one_split_comparison(spark, folder):
    """Baseline beside a forest of one tree with one split, on the month."""
    sales, stores, products = _trio(spark, folder, "sparse")
    stump = regressors.indexed_forest("one_split", numTrees=1, maxDepth=1, featureSubsetStrategy="all")
    compared = regressors.compare_models(panel.daily_panel(sales), stores, products, [stump], MONTH_SPEC, AS_OF_YEAR)
    return _out(compared, "rmse")


def bucketed_predictions(spark, folder):
    """The baseline's test predictions from tables bucketed by store and product."""
    rows = layout.bucketed(_dense_panel(spark, folder), buckets=8)
    with working() as keep, layout.as_laid_out(spark):
        flagged = stage(split.flag_split(rows), "flagged")
        fit = layout.bucketed(baseline.fit_panel(flagged.where("is_train")), buckets=8)
        test = rows.join(split.split_cutoff(rows).select("cutoff"), F.col("date") > F.col("cutoff")).drop("cutoff")
        found = baseline.apply_fit(test, fit, "year_month", "inner")
        return keep(stage(_out(found.select("date", "store_id", "product_id", "qty", "prediction"), "qty", "prediction"), "bucketed"))


LINEAR_SPEC = features.FeatureSpec(numeric=("month", "day_of_week"))


def linear_sums(spark, folder):
    """The normal equations of the train rows: month, day of the week and all categories against quantity."""
    sales, stores, products = _trio(spark, folder, "sparse")
    train = split.flag_split(panel.daily_panel(sales)).where("is_train")
    with working() as keep:
        rows = stage(panel.enrich(train, stores, products, AS_OF_YEAR), "train-rows")
        made = least_squares.design(rows, stores, products, LINEAR_SPEC, origin=(0.0, 0.0))
        sums = least_squares.named_sums(least_squares.equation_sums(rows, made), made)
        return _out(keep(stage(sums, "linear-sums")), "total")


def rolling_linear_scores(spark, folder):
    """A linear model on month and day of the week, fitted on each fold's past from running sums."""
    spec = features.FeatureSpec(numeric=("month", "day_of_week"), store_categories=(), product_categories=())
    scores = least_squares.rolling_linear_scores(*_panel_and_dimensions(spark, folder), spec, **FOLDS, as_of_year=AS_OF_YEAR)
    return _out(scores, "rmse")


def rolling_linear_category_scores(spark, folder):
    """The same folds with date parts and all categories."""
    scores = least_squares.rolling_linear_scores(*_panel_and_dimensions(spark, folder), **FOLDS, as_of_year=AS_OF_YEAR)
    return _out(scores, "rmse")


def _panel_and_dimensions(spark, folder):
    sales, stores, products = _trio(spark, folder, "sparse")
    return panel.daily_panel(sales), stores, products


def model_comparison(spark, folder):
    sales, stores, products = _trio(spark, folder, "sparse")
    compared = regressors.compare_models(panel.daily_panel(sales), stores, products, as_of_year=AS_OF_YEAR)
    return _out(compared, "rmse")


def horizon_models(spark, folder):
    return _out(regressors.horizon_errors(standin.sales(spark, folder)), "rmse")


def horizon_model_forecast(spark, folder):
    names = ["demand_30", "demand_60", "demand_90"]
    return _out(regressors.horizon_forecast(standin.sales(spark, folder)), *names)


def horizon_one_input(spark, folder):
    """A model per horizon on the day's quantity alone."""
    return _out(regressors.horizon_errors(standin.sales(spark, folder), inputs=["qty"]), "rmse")


def horizon_one_input_forecast(spark, folder):
    names = ["demand_30", "demand_60", "demand_90"]
    return _out(regressors.horizon_forecast(standin.sales(spark, folder), inputs=["qty"]), *names)


def autoregression_of_order_one(spark, folder):
    days = panel.daily_totals(standin.sales(spark, folder), ["store_id"])
    days = series.fill_calendar(days, ["store_id"], "date", "qty", unit="day")
    return _out(regressors.autoregressive_forecast(days, ["store_id"], order=1, steps=30), "prediction")


def autoregressive_forecast(spark, folder):
    sales = standin.sales(spark, folder)
    days = series.fill_calendar(panel.daily_totals(sales, ["store_id"]), ["store_id"], "date", "qty", unit="day")
    return _out(regressors.autoregressive_forecast(days, ["store_id"], order=7, steps=90), "prediction")


def _store_days(spark, folder):
    days = panel.daily_totals(standin.sales(spark, folder), ["store_id"])
    return series.fill_calendar(days, ["store_id"], "date", "qty", unit="day")


def autoregression_by_store(spark, folder):
    """Each store's own autoregression of order one."""
    return _out(regressors.autoregressive_forecast_by_series(_store_days(spark, folder), ["store_id"], order=1, steps=30), "prediction")


def autoregressive_forecast_by_store(spark, folder):
    return _out(regressors.autoregressive_forecast_by_series(_store_days(spark, folder), ["store_id"], order=7, steps=90), "prediction")


# -- forecast --------------------------------------------------------------------------------------------------


def _forecast(spark, folder, work, **options):
    return work(*_trio(spark, folder), **options)


def future_calendar(spark, folder):
    return forecast.future_calendar(standin.sales(spark, folder, "sparse"))


def forecast_grid_size(spark, folder):
    return forecast.grid_size(*_trio(spark, folder, "sparse"))


def forecast_cells(spark, folder):
    with session_options(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):  # lets the grid stay where it is
        return stage(_out(_forecast(spark, folder, forecast.forecast_cells), "prediction"), "cells")


def forecast_daily_by_product(spark, folder):
    return _out(_forecast(spark, folder, forecast.forecast_daily), "prediction").orderBy(F.desc("date"), "product_id")


def forecast_daily_by_store(spark, folder):
    return _out(_forecast(spark, folder, forecast.forecast_daily, level="store_id"), "prediction")


def forecast_daily_train_fit(spark, folder):
    return _out(_forecast(spark, folder, forecast.forecast_daily, fit_on="train"), "prediction")


def forecast_daily_zero_filled(spark, folder):
    return _out(_forecast(spark, folder, forecast.forecast_daily, zero_fill=True), "prediction")


def forecast_daily_train_zero_filled(spark, folder):
    """Fitted up to the split date, which cuts a month: only its days until then are days without a sale."""
    return _out(_forecast(spark, folder, forecast.forecast_daily, fit_on="train", zero_fill=True), "prediction")


HORIZON_COLUMNS = [f"demand_{h}" for h in forecast.HORIZONS]


def forecast_horizons_by_product(spark, folder):
    return _out(_forecast(spark, folder, forecast.forecast_horizons), *HORIZON_COLUMNS)


def forecast_horizons_by_store(spark, folder):
    return _out(_forecast(spark, folder, forecast.forecast_horizons, level="store_id"), *HORIZON_COLUMNS)


def forecast_csv_round_trip(spark, folder):
    """The forecast written as CSV to the shared scratch folder and read back."""
    path = scratch_path(spark, "forecast-csv")
    sinks.write_forecast(forecast_daily_by_product(spark, folder), path)
    return sinks.read_forecast_csv(spark, path, "date date, product_id string, prediction double")


# -- extensions ------------------------------------------------------------------------------------------------


def lag_features(spark, folder):
    rows = lags.lag_features(_dense_panel(spark, folder), ["store_id", "product_id"], [1, 7])
    return _out(rows, "qty", "qty_lag_1", "qty_lag_7")


def calendar_lag_features(spark, folder):
    days = panel.daily_totals(standin.sales(spark, folder), ["store_id"])
    rows = lags.lag_features(days, ["store_id"], [7, 365], by="day")
    rows = lags.trailing_means(rows, ["store_id"], [28])
    return _out(rows, "qty", "qty_lag_7", "qty_lag_365", "qty_mean_28")


def first_difference(spark, folder):
    months = panel.monthly_totals(standin.sales(spark, folder), ["store_id"])
    return _out(lags.first_difference(months, ["store_id"], at="month_start"), "qty", "qty_diff")


FOLDS = {"n_folds": 4, "test_days": 90, "gap_days": 30}


def rolling_folds(spark, folder):
    return split.fold_bounds(standin.sales(spark, folder, "sparse"), **FOLDS)


def rolling_scores(spark, folder):
    return _out(validation.rolling_scores(_staged_panel(spark, folder), **FOLDS), "rmse")


def calendar_join(spark, folder):
    days = panel.daily_totals(standin.sales(spark, folder), ["store_id"])
    joined = panel.with_calendar(days, standin.monthly_order_value(spark, folder), on="month_start")
    return _out(joined, "qty", "mean_order_value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sales_rows,
        store_rows,
        product_rows,
        plain_dimension,
        calendar_days,
        clean_decimal_comma,
        clean_default_types,
        parse_audit,
        audited_write,
        accepted_rows,
        null_audit,
        complete_rows,
        row_counts,
        date_features,
        month_keys,
        monthly_sales,
        monthly_sales_by_store,
        daily_sales,
        daily_panel,
        enriched_panel,
        store_age,
        distinct_dimensions,
        distinct_keys,
        decompose_monthly,
        decompose_additive,
        decompose_by_store,
        decompose_by_store_issues,
        decompose_refused,
        autocorrelation_daily,
        autocorrelation_by_store,
        correlation_matrix,
        collinear_pairs,
        correlation_wide,
        variance_inflation,
        category_index_store,
        category_index_product,
        onehot_store,
        onehot_product,
        encoder_slots,
        category_bins,
        scaled_features,
        hashed_features,
        hashed_feature_sums,
        split_cutoff,
        chrono_split,
        baseline_fit,
        panel_refreshed,
        fit_refreshed,
        baseline_fit_one_shuffle,
        baseline_train_predictions,
        baseline_test_predictions,
        baseline_rmse,
        baseline_rmse_seasonal,
        baseline_apply_fit,
        lr_single_feature,
        linear_rmse,
        linear_vectors_rmse,
        assembled_vector_sums,
        one_split_comparison,
        bucketed_predictions,
        linear_sums,
        rolling_linear_scores,
        rolling_linear_category_scores,
        forest_rmse,
        forest_indexed_rmse,
        model_comparison,
        horizon_models,
        horizon_model_forecast,
        horizon_one_input,
        horizon_one_input_forecast,
        autoregression_of_order_one,
        autoregressive_forecast,
        autoregression_by_store,
        autoregressive_forecast_by_store,
        future_calendar,
        forecast_grid_size,
        forecast_cells,
        forecast_daily_by_product,
        forecast_daily_by_store,
        forecast_daily_train_fit,
        forecast_daily_zero_filled,
        forecast_daily_train_zero_filled,
        forecast_horizons_by_product,
        forecast_horizons_by_store,
        forecast_csv_round_trip,
        lag_features,
        calendar_lag_features,
        first_difference,
        rolling_folds,
        rolling_scores,
        calendar_join,
    )
}
