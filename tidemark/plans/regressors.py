"""Linear and random-forest regressors on the enriched panel, and one model per horizon."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.binning import category_means, fit_bins
from tidemark.operators.encoders import TableEncoder
from tidemark.operators.features import (
    FeatureSpec,
    bin_name,
    category_hasher,
    fit_encoders,
    index_name,
    unit_scaler,
    vector_name,
)
from tidemark.operators.lags import demand_ahead, lag_features, trailing_means
from tidemark.operators.panel import daily_totals, enrich
from tidemark.operators.series import fill_calendar
from tidemark.operators.split import flag_split
from tidemark.operators.stats import rmse
from tidemark.plans import least_squares
from tidemark.plans.baseline import predict
from tidemark.plans.vector_fit import VectorRegression
from tidemark.runtime import file_by_file, files_of, stage, unstage, working


def encoders(
    stores: DataFrame, products: DataFrame, spec: FeatureSpec = FeatureSpec(), known: DataFrame | None = None
) -> tuple[list, dict[str, list[str]]]:
    """Fitted stages that take enriched panel rows (:func:`enrich`) to feature inputs, and the inputs by kind.

    Kinds: ``one_hot`` (numeric columns and a vector per category) and ``indexed`` (numeric columns and an index per
    category, for trees). Categories are fitted on the dimensions, so the fits see each store and product once. With the
    train rows ``known``, categories of more than ``spec.tree_width`` values are binned by their mean target in
    ``indexed``; the target is summed by store and by product first.
    """
    stages, used, indexed = [], [], []
    for dim, key, columns in ((stores, "store_id", spec.store_categories), (products, "product_id", spec.product_categories)):
        fitted, vectors = fit_encoders(dim, [c for c in columns if c not in spec.hashed], spec.invalid)
        stages, used = stages + fitted, used + vectors
        wide = [c for c in vectors if known is not None and fitted[0].slots(c) > spec.tree_width]
        if wide:
            target = F.col(spec.target)
            sums = known.groupBy(key).agg(F.count(target).alias("_n"), F.sum(target).alias("_total")).join(dim, key)
            stages = [*stages, fit_bins(category_means(sums, wide, "_total", F.col("_n")), spec.tree_bins)]
            wide = stages[-1].getOrDefault("columns")  # those with a train row
        indexed += [bin_name(c) if c in wide else index_name(c) for c in vectors]
    extra = ["hashed_vec"] if spec.hashed else []
    if spec.hashed:
        stages = [*stages, category_hasher(spec.hashed, spec.hash_width)]
    return stages, {
        "one_hot": [*spec.numeric, *map(vector_name, used), *extra],
        "indexed": [*spec.numeric, *indexed, *extra],
    }


def model_rows(
    flagged: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    as_of_year: int | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Panel rows (with ``is_train``) with encoded features, and the feature inputs by kind (:func:`encoders`)."""
    stages, inputs = encoders(stores, products, spec)
    return _encoded(flagged, stores, products, stages, inputs.values(), spec, as_of_year), inputs


def _encoded(flagged, stores, products, stages, inputs, spec, as_of_year) -> DataFrame:
    rows = PipelineModel(stages=stages).transform(enrich(flagged, stores, products, as_of_year))
    return _model_columns(rows, [c for names in inputs for c in names], spec)


def _model_columns(rows: DataFrame, inputs: Sequence[str], spec: FeatureSpec) -> DataFrame:
    target = F.col(spec.target).cast("double").alias(spec.target)
    return rows.select(*spec.ids, target, "is_train", *dict.fromkeys(inputs))


def _inputs_of(stage_) -> set[str]:
    return set(stage_.getOrDefault("columns") if isinstance(stage_, TableEncoder) else stage_.getInputCols())


def _encoded_dimensions(flagged, stores, products, stages, spec) -> tuple[list[DataFrame], list]:
    """Both dimensions after those of the stages that take their categories, and the stages that are left.

    A NULL category is an error only where a row has it, so of a dimension with some only the rows that are met are encoded.
    """
    out, left = [], list(stages)
    for dim, key, columns in ((stores, "store_id", spec.store_categories), (products, "product_id", spec.product_categories)):
        columns = [c for c in columns if c not in spec.hashed]
        names = {x for c in columns for x in (c, index_name(c))}
        own = [s for s in left if _inputs_of(s) <= names]
        left = [s for s in left if s not in own]
        if columns and spec.invalid == "error" and not dim.where(" OR ".join(f"`{c}` IS NULL" for c in columns)).isEmpty():
            met = flagged.join(stores.select("store_id"), "store_id", "left_semi").join(products.select("product_id"), "product_id", "left_semi")
            dim = dim.join(met.select(key).distinct(), key, "left_semi")
        out.append(PipelineModel(stages=own).transform(dim))
    return out, left


def _one_hot_rows(flagged, stores, products, stages, inputs, spec, as_of_year) -> DataFrame:
    """Rows with ``features_raw``, assembled from the numbers, a vector per dimension and hashed categories.

    Categories are encoded in their dimension, once a store or product, and rows get its vector by the joins of :func:`enrich`.
    Vectors say how many slots they have, not what each slot is: that would be in the footer of every file.
    """
    dims, late = _encoded_dimensions(flagged, stores, products, stages, spec)
    parts, found = [], []
    for dim, columns in zip(dims, (spec.store_categories, spec.product_categories)):
        vectors = [vector_name(c) for c in columns if vector_name(c) in inputs]
        if vectors:
            name = f"_vector{len(parts)}"
            dim = _sized(VectorAssembler(inputCols=vectors, outputCol=name).transform(dim), name)
            parts.append(name)
        found.append(dim.drop(*[x for c in columns if c not in (*spec.hashed, *spec.numeric) for x in (c, index_name(c), vector_name(c))]))
    rows = PipelineModel(stages=late).transform(enrich(flagged, *found, as_of_year))
    extra = [c for c in inputs if c not in spec.numeric and c not in map(vector_name, (*spec.store_categories, *spec.product_categories))]
    columns = [*spec.numeric, *parts, *extra]
    made = VectorAssembler(inputCols=columns, outputCol="features_raw").transform(_model_columns(rows, columns, spec))
    return _sized(made, "features_raw")


def _sized(rows: DataFrame, vector: str) -> DataFrame:
    """The column's metadata cut to its number of slots."""
    known = rows.schema[vector].metadata.get("ml_attr", {})
    size = known.get("num_attrs", sum(map(len, known.get("attrs", {}).values())))
    return rows.withColumn(vector, F.col(vector).alias(vector, metadata={"ml_attr": {"num_attrs": size}}))


def vector_sums(table: DataFrame, column: str) -> DataFrame:
    """``(slot, total)``: the sum of each slot that any vector of the column fills, merged before one shuffle by slot."""
    v = F.unwrap_udt(column)
    cell = lambda i, x: F.struct(i.cast("int").alias("slot"), x.alias("total"))
    dense = F.transform(v["values"], lambda x, i: cell(i, x))
    cells = F.when(v["type"] == 0, F.zip_with(v["indices"], v["values"], cell)).otherwise(dense)
    return table.select(F.inline(cells)).groupBy("slot").agg(F.sum("total").alias("total"))


def slot_names(stages: Sequence, spec: FeatureSpec) -> DataFrame:
    """``(slot, name)`` of the one-hot input vector that the stages of :func:`encoders` lead to: numbers by their name,
    categories as ``feature=value``. The last value of a category has no slot. Hashed categories are not named."""
    first, parts = len(spec.numeric), []
    encoders_ = [s for s in stages if isinstance(s, TableEncoder) and s.getOrDefault("nominal")]
    for encoder in encoders_:
        for c in encoder.getOrDefault("columns"):
            width = encoder.slots(c) - 1
            if width:
                part = encoder.table.where((F.col("feature") == c) & (F.col("slot") < width))
                parts.append(part.select((F.col("slot") + first).cast("int").alias("slot"), F.concat_ws("=", "feature", "value").alias("name")))
            first += width
    spark = SparkSession.active()
    out = spark.createDataFrame(list(enumerate(spec.numeric)), "slot int, name string")
    for part in parts:
        out = out.unionByName(part)
    return out


ROWS_PER_PARTITION = 250_000
ROWS_PER_FILE = 500_000  # of a model table, which is as many as a task of a fit holds
SCALED_BY = 32  # tasks of a scaler's fit: each sends a number per slot to one task, times the moments


def fit_partitions(staged: DataFrame) -> int:
    """Partitions for rows about to become feature vectors: by row count, since vectors are far larger than the
    columns they come from. The number follows the data and not the machine, as a forest's sampling does."""
    return max(16, -(-staged.count() // ROWS_PER_PARTITION))


def linear(
    label: str = "qty", features: str = "features", prediction: str = "linear", solver: str = "l-bfgs"
) -> LinearRegression:
    """Least squares by one named solver: ``l-bfgs`` for any width (by blocks of vectors, :class:`VectorRegression`), ``normal``
    (exact) up to 4,096 features."""
    kind = VectorRegression if solver == "l-bfgs" else LinearRegression
    return kind(featuresCol=features, labelCol=label, predictionCol=prediction, solver=solver)


def forest(
    label: str = "qty", features: str = "features", prediction: str = "forest", seed: int = 7, **params
) -> RandomForestRegressor:
    """Trees that differ by the features each node may use. Rows are not sampled, since which rows a sample holds depends
    on how they are partitioned; ``bootstrap=True`` brings that back."""
    settings = {"numTrees": 20, "maxDepth": 5, "bootstrap": False} | params
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, predictionCol=prediction, seed=seed, **settings
    )


def indexed_forest(prediction: str = "forest_indexed", **params) -> RandomForestRegressor:
    """The forest on category indexes and, for wide categories, bins in order of the mean target (``FeatureSpec``). A row
    is one number per column instead of one per category, and no column has more than a bounded number of slots."""
    return forest(features="tree_features", prediction=prediction, **params)


def _widest_category(rows: DataFrame, columns: Sequence[str]) -> int:
    return max((rows.schema[c].metadata.get("ml_attr", {}).get("num_vals", 0) for c in columns), default=0)


def _widest_key(stages: Sequence, spec: FeatureSpec) -> str:
    """The key of the dimension whose categories have more slots."""
    slots = lambda columns: sum(s.slots(c) for s in stages if isinstance(s, TableEncoder) for c in s.getOrDefault("columns") if c in columns)
    return "product_id" if slots(spec.product_categories) > slots(spec.store_categories) else "store_id"


@dataclass
class Trained:
    """``table``: the staged model rows, scored by ``scorer``; ``pipeline``: from enriched rows (:func:`enrich`), seen in
    training or not, to predictions, savable."""

    table: DataFrame
    scorer: PipelineModel
    pipeline: PipelineModel


def train(
    flagged: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    models: Sequence,
    spec: FeatureSpec = FeatureSpec(),
    as_of_year: int | None = None,
    scale_on: str = "train",
    partitions: int | None = None,
) -> Trained:
    """Fit regressors on the train rows of a staged, flagged panel.

    Each input vector is assembled once and written, in the order of the ids; the scaler and every fit then read one
    column. For linear models alone, rows are dealt and put in order by store or product, whichever has more slots, so that rows of
    one fit block share their slots. Fits hold their rows, so of a table larger than ``ROWS_PER_FILE`` they read each file
    by a task of its own: vectors are small on disk, and a task would otherwise get as many files as make 128 MB. The
    standard deviations come from the train rows, or from all rows with ``scale_on="all"``.
    """
    spark = flagged.sparkSession
    n = partitions or fit_partitions(flagged)
    trees = any(m.getFeaturesCol() == "tree_features" for m in models)
    vectors = any(m.getFeaturesCol() != "tree_features" for m in models)
    stages, inputs = encoders(stores, products, spec, flagged.where("is_train") if trees else None)
    assemblers = []
    if vectors:
        assemblers.append(VectorAssembler(inputCols=inputs["one_hot"], outputCol="features_raw"))
    if trees:
        assemblers.append(VectorAssembler(inputCols=inputs["indexed"], outputCol="tree_features"))
    names = [a.getOutputCol() for a in assemblers]
    order = list(spec.ids)
    if all(isinstance(m, VectorRegression) for m in models):
        order = list(dict.fromkeys([_widest_key(stages, spec), *order]))
        rows = _one_hot_rows(flagged, stores, products, stages, inputs["one_hot"], spec, as_of_year)
        assembled = rows.select(*spec.ids, spec.target, "is_train", *names).repartition(n, order[0])
    else:
        kinds = ["one_hot"] * vectors + ["indexed"] * trees
        rows = _encoded(flagged.repartition(n, *spec.ids), stores, products, stages, [inputs[k] for k in kinds], spec, as_of_year)
        if trees:
            bins = max(32, spec.tree_bins, _widest_category(rows, inputs["indexed"]))
            models = [m.copy({m.maxBins: bins}) if m.getFeaturesCol() == "tree_features" else m for m in models]
        assembled = PipelineModel(stages=assemblers).transform(rows).select(*spec.ids, spec.target, "is_train", *names)
    with files_of(spark, ROWS_PER_FILE):
        table = stage(assembled, "model-table", sort=order)
    known = table.where("is_train")
    with file_by_file(spark) if table.count() > ROWS_PER_FILE else nullcontext():
        seen = known if scale_on == "train" else table
        scalers = [unit_scaler("features_raw").fit(seen.coalesce(SCALED_BY))] if vectors else []
        scaled = PipelineModel(stages=scalers).transform(known)
        scorer = PipelineModel(stages=[*scalers, *[m.fit(scaled) for m in models]])
    return Trained(table, scorer, PipelineModel(stages=[*stages, *assemblers, *scorer.stages]))


def model_errors(predicted: DataFrame, models: Sequence[str], label: str = "qty") -> DataFrame:
    """``(model, split, n_rows, n_scored, rmse)`` for several prediction columns, from one aggregate over the rows."""
    split = F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test"))
    long = predicted.select(
        split.alias("split"),
        F.col(label).cast("double").alias("_y"),
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("_p")) for m in models])
        ),
    )
    return rmse(long, "_y", "_p", ["model", "split"])


def compare_models(
    panel: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    models: Sequence | None = None,
    spec: FeatureSpec = FeatureSpec(),
    as_of_year: int | None = None,
    scale_on: str = "train",
    share: float = 0.8,
) -> DataFrame:
    """Baseline and regressors side by side on the same split, scored on train and test rows.

    Without ``models``: least squares from sums by category (:mod:`tidemark.plans.least_squares`), or by iteration where the
    design is too wide for it or hashed, and a forest.
    """
    with working() as keep:
        flagged = stage(flag_split(panel, share), "panel")
        baseline = predict(flagged).withColumnRenamed("prediction", "baseline")
        errors = model_errors(baseline, ["baseline"], spec.target)
        if models is None:
            models = [indexed_forest(label=spec.target)]
            try:
                errors = errors.unionByName(least_squares.linear_errors(flagged, stores, products, spec, as_of_year))
            except least_squares.TooWide:
                models = [linear(spec.target), *models]
        errors = errors.unionByName(regressor_errors(flagged, stores, products, models, spec, as_of_year, scale_on))
        return keep(stage(errors, "model-errors"))  # two rows a model


def regressor_errors(
    flagged: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    models: Sequence,
    spec: FeatureSpec = FeatureSpec(),
    as_of_year: int | None = None,
    scale_on: str = "train",
) -> DataFrame:
    """Errors of freshly trained regressors on a staged, flagged panel, without the baseline. Nothing else is left staged."""
    with working() as keep:
        trained = train(flagged, stores, products, models, spec, as_of_year, scale_on)
        scored = trained.scorer.transform(trained.table)
        return keep(stage(model_errors(scored, [m.getPredictionCol() for m in models], spec.target), "model-errors"))


# -- one model per horizon -------------------------------------------------------------------------------------

ORIGIN_LAGS = (1, 7, 28)
ORIGIN_MEANS = (7, 28, 91)


def origin_table(
    sales: DataFrame, keys: Sequence[str] = ("store_id",), horizons: Sequence[int] = (30, 60, 90), share: float = 0.8
) -> tuple[DataFrame, list[str]]:
    """One row per series and day: what is known that day, the demand of the next h days, and ``is_train``.

    ``ready_<h>`` marks days whose h days ahead are all observed. The features never look past their day; on the
    first days of a series the lags are NULL.
    """
    keys = list(keys)
    series = fill_calendar(daily_totals(sales, keys), keys, "date", "qty", unit="day")
    # split here, where a day's rows are still cheap to count
    rows = lag_features(flag_split(series, share), keys, ORIGIN_LAGS)
    rows = trailing_means(rows, keys, ORIGIN_MEANS)
    rows = demand_ahead(rows, keys, horizons)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ["qty", *[f"qty_lag_{k}" for k in ORIGIN_LAGS]]})
    last = sales.agg(F.max("date").alias("last")).scalar()
    rows = rows.withColumns({f"ready_{h}": F.date_add("date", h) <= last for h in horizons})
    inputs = ["qty", *[f"qty_lag_{k}" for k in ORIGIN_LAGS], *[f"qty_mean_{d}" for d in ORIGIN_MEANS]]
    return rows, inputs


def fit_horizons(
    sales: DataFrame,
    keys: Sequence[str] = ("store_id",),
    horizons: Sequence[int] = (30, 60, 90),
    share: float = 0.8,
    inputs: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str], dict[int, PipelineModel]]:
    """A linear model per horizon on one staged origin table.

    An origin trains model h only if its h days ahead end by the split date, so no test demand is seen in training.
    ``inputs``: some of the origin table's, by default all.
    """
    table, known_inputs = origin_table(sales, keys, horizons, share)
    inputs = list(inputs or known_inputs)
    table = stage(table, "origins")
    cutoff = table.where("is_train").agg(F.max("date").alias("cutoff")).scalar()
    known = table.na.drop(subset=inputs)
    fitted = {}
    for h in horizons:
        pipeline = Pipeline(
            stages=[
                VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
                linear(f"qty_next_{h}", prediction=f"ahead_{h}", solver="normal"),
            ]
        )
        fitted[h] = pipeline.fit(known.where(F.date_add("date", h) <= cutoff))
    return table, inputs, fitted


def _with_predictions(rows: DataFrame, inputs: Sequence[str], fitted: dict[int, PipelineModel]) -> DataFrame:
    """``ahead_<h>`` from each model; NULL where a lag is missing."""
    complete = F.lit(True)
    for c in inputs:
        complete = complete & F.col(c).isNotNull()
    for h, model in fitted.items():
        rows = model.transform(rows).drop("features")
        rows = rows.withColumn(f"ahead_{h}", F.when(complete, F.col(f"ahead_{h}")))
    return rows


def horizon_errors(
    sales: DataFrame,
    keys: Sequence[str] = ("store_id",),
    horizons: Sequence[int] = (30, 60, 90),
    share: float = 0.8,
    inputs: Sequence[str] | None = None,
) -> DataFrame:
    """``(horizon, split, n_rows, n_scored, rmse)``; origins between the last trainable and the split date count to
    neither split."""
    table, inputs, fitted = fit_horizons(sales, keys, horizons, share, inputs)
    cutoff = table.where("is_train").agg(F.max("date").alias("cutoff")).scalar()
    scored = _with_predictions(table, inputs, fitted)
    cases = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.col(f"qty_next_{h}").alias("_y"),
                F.col(f"ahead_{h}").alias("_p"),
                F.when(F.date_add("date", h) <= cutoff, F.lit("train"))
                .when(~F.col("is_train") & F.col(f"ready_{h}"), F.lit("test"))
                .alias("split"),
            )
            for h in fitted
        ]
    )
    long = scored.select(F.inline(cases)).where("split IS NOT NULL")
    out = stage(rmse(long, "_y", "_p", ["horizon", "split"]), "horizon-errors")  # two rows a horizon
    unstage(table)
    return out


def horizon_forecast(
    sales: DataFrame,
    keys: Sequence[str] = ("store_id",),
    horizons: Sequence[int] = (30, 60, 90),
    share: float = 0.8,
    inputs: Sequence[str] | None = None,
) -> DataFrame:
    """Demand of the h days after each series' last day, each horizon from its own model.

    Direct multi-step forecasting: no prediction is fed back as an input. A series too short for the lags gets NULL.
    """
    table, inputs, fitted = fit_horizons(sales, keys, horizons, share, inputs)
    latest = table.groupBy(*keys).agg(F.max_by(F.struct("date", *inputs), "date").alias("end")).select(*keys, "end.*")
    ahead = _with_predictions(latest, inputs, fitted).select(
        *keys, "date", *[F.col(f"ahead_{h}").alias(f"demand_{h}") for h in horizons]
    )
    out = stage(ahead, "horizon-forecast")  # a row per series
    unstage(table)
    return out


# -- autoregression --------------------------------------------------------------------------------------------


def autoregressive_forecast(
    series: DataFrame,
    keys: Sequence[str],
    order: int = 7,
    steps: int = 30,
    at: str = "date",
    value: str = "qty",
    difference: bool = False,
) -> DataFrame:
    """Recursive forecast: each step's prediction becomes an input of the next.

    One linear model on ``order`` lags is fitted over all series. The recursion runs per series inside one column
    expression on the array of its last ``order`` values, so all series advance in parallel and nothing leaves the
    executors. With ``difference`` the model works on day-to-day changes and the result is summed back to levels.
    ``series`` must have a row for every day.
    """
    keys = list(keys)
    rows = series.select(*keys, at, F.col(value).cast("double").alias("_level")).withColumn("_y", F.col("_level"))
    if difference:
        lagged = lag_features(rows, keys, [1], at, "_level")
        rows = lagged.withColumn("_y", F.col("_level") - F.col("_level_lag_1"))
    lags = range(1, order + 1)
    table = lag_features(rows.where("_y IS NOT NULL"), keys, lags, at, "_y")
    table = stage(table, "autoregression")
    inputs = [f"_y_lag_{k}" for k in lags]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip")
    model = linear("_y", solver="normal").fit(assembler.transform(table))
    weights = [float(w) for w in model.coefficients]

    # newest first: the row itself, then its lags
    recent = F.array("_y", *[f"_y_lag_{k}" for k in range(1, order)])
    ends = table.groupBy(*keys).agg(F.max_by(F.struct(F.col(at), "_level", recent.alias("recent")), at).alias("end"))
    state = ends.select(
        *keys, F.col(f"end.{at}").alias("_at"), F.col("end._level").alias("_level"), F.col("end.recent").alias("recent")
    )

    def step(path, _):
        nxt = F.lit(float(model.intercept))
        for k, w in enumerate(weights, start=1):
            nxt = nxt + F.lit(w) * F.get(path, F.lit(k - 1))
        return F.array_prepend(path, nxt)

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("recent"), step)
    ahead = F.reverse(F.slice(path, 1, steps))
    out = state.select(*keys, "_at", "_level", F.posexplode(ahead).alias("_pos", "_p"))
    prediction = F.col("_p")
    if difference:
        so_far = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        prediction = F.col("_level") + F.sum("_p").over(so_far)
    return out.select(
        *keys,
        (F.col("_pos") + 1).alias("step"),
        F.date_add("_at", F.col("_pos") + 1).alias(at),
        prediction.alias("prediction"),
    )


def lag_products(series: DataFrame, keys: Sequence[str], order: int, at: str = "date", value: str = "qty") -> DataFrame:
    """``(*keys, n, mean, products)`` of each series: sums of products of the value and its ``order`` lags, less the mean.

    ``products`` holds the upper triangle of the matrix over (1, value, lag 1, ...) row by row, from the rows that have all
    lags; ``n`` counts them. ``series`` must have a row for every day.
    """
    keys = list(keys)
    means = series.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    rows = series.select(*keys, at, F.col(value).cast("double").alias("_y")).join(means, keys)
    rows = rows.withColumn("_y", F.col("_y") - F.col("mean"))
    table = lag_features(rows.where("_y IS NOT NULL"), keys, range(1, order + 1), at, "_y")
    terms = [F.lit(1.0), F.col("_y"), *[F.col(f"_y_lag_{k}") for k in range(1, order + 1)]]
    table = table.where(F.col(f"_y_lag_{order}").isNotNull())
    sums = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]]
    return table.groupBy(*keys).agg(F.count("*").alias("n"), F.first("mean").alias("mean"), F.array(*sums).alias("products"))


def series_coefficients(products: DataFrame, keys: Sequence[str], order: int) -> DataFrame:
    """``(*keys, n, mean, intercept, weights)`` by least squares, a batch of series to one stack of small solves.

    ``intercept`` and ``weights`` (lag 1 first) apply to values less the series' mean. Where lags depend on each other, as
    in a constant series, the shortest of the equal solutions is taken.
    """
    width = order + 2

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(width)
        for batch in batches:
            flat = np.array(batch.column("products").to_pylist(), float).reshape(-1, len(upper[0]))
            full = np.zeros((len(flat), width, width))
            full[:, upper[0], upper[1]] = flat
            full[:, upper[1], upper[0]] = flat
            inputs = [0, *range(2, width)]
            gram, moment = full[:, inputs][:, :, inputs], full[:, inputs, 1]
            scale = np.sqrt(np.einsum("kii->ki", gram))
            scale[scale == 0] = 1
            inverse = np.linalg.pinv(gram / scale[:, :, None] / scale[:, None, :], rcond=1e-11, hermitian=True)
            weights = np.einsum("kij,kj->ki", inverse, moment / scale) / scale
            columns = [batch.column(c) for c in (*keys, "n", "mean")]
            lists = pa.array(weights[:, 1:].tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weights[:, 0]), lists], names=[*keys, "n", "mean", "intercept", "weights"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in products.schema if f.name != "products")
    return products.mapInArrow(solved, f"{kinds}, intercept double, weights array<double>")


def autoregressive_forecast_by_series(
    series: DataFrame, keys: Sequence[str], order: int = 7, steps: int = 30, at: str = "date", value: str = "qty"
) -> DataFrame:
    """``(*keys, step, at, prediction)`` like :func:`autoregressive_forecast`, with coefficients of each series' own.

    A series without ``order + 1`` days of values has no fit and NULL predictions.
    """
    keys = list(keys)
    fits = series_coefficients(lag_products(series, keys, order, at, value), keys, order)
    lagged = lag_features(series.select(*keys, at, F.col(value).cast("double").alias("_y")), keys, range(1, order), at, "_y")
    recent = F.array("_y", *[f"_y_lag_{k}" for k in range(1, order)])
    ends = lagged.groupBy(*keys).agg(F.max_by(F.struct(F.col(at).alias("_at"), recent.alias("_recent")), at).alias("end"))
    state = ends.select(*keys, "end.*").join(fits, keys, "left")
    known = F.transform("_recent", lambda y: y - F.col("mean"))

    def step(path, _):
        parts = F.zip_with(F.slice(path, 1, order), F.col("weights"), lambda y, w: y * w)
        return F.array_prepend(path, F.aggregate(parts, F.col("intercept"), lambda total, x: total + x))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), known, step)
    ahead = F.transform(F.reverse(F.slice(path, 1, steps)), lambda y: y + F.col("mean"))
    none = F.array_repeat(F.lit(None).cast("double"), steps)
    out = state.select(*keys, "_at", F.posexplode(F.coalesce(ahead, none)).alias("_pos", "prediction"))
    return out.select(*keys, (F.col("_pos") + 1).alias("step"), F.date_add("_at", F.col("_pos") + 1).alias(at), "prediction")
