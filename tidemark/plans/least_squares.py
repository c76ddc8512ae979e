"""Least squares on categories and numbers from sums by category, without feature vectors.

A one-hot design has few distinct products of columns: the number of rows with a pair of categories, the sum of a number
over the rows of a category. These sums are the normal equations. They come from aggregates that merge before each shuffle:
the rows are summed to (store, product) once, and everything between categories follows from that table and the
dimensions, where a row stands for all days of its pair. The equations are solved on the driver, up to ``WIDEST`` columns;
a collinear column, such as the region beside the stores, is found by a pivot that vanishes and left out.

A wider design is solved in two parts, exactly. A row has one value of a category, so among the slots of the widest one the
equations are diagonal: each slot is eliminated by itself, on the executors, and the driver solves what that leaves of the
other columns. The slots' coefficients follow from that solution, each from its own sums.

Predictions are sums again: an effect per store, an effect per product, and the numbers times their slopes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.encoders import fit_index
from tidemark.operators.features import FeatureSpec
from tidemark.operators.panel import enrich
from tidemark.operators.stats import rmse
from tidemark.runtime import stage, working

WIDEST = 4096  # columns of the equations: 134 MB on the driver
CELLS = 1 << 21  # numbers of a dense block of slots in a task: 16 MB
ALIKE = 1e-9  # of a column's spread that must be left beside the columns before it


class TooWide(ValueError):
    """More columns than one solve on the driver takes, those of the widest category aside, or hashed ones."""


@dataclass(frozen=True)
class Design:
    """Columns of the equations: the constant, ``numbers`` less their ``origin``, and the slots of ``categories``.

    ``slots`` is a table ``(feature, value, slot)`` with slots from ``1 + len(numbers)`` on, ``width`` the number of columns.
    ``apart``: first slot and end of the widest category where the columns are too many for one solve, else empty.
    """

    numbers: tuple[str, ...]
    origin: tuple[float, ...]
    slots: DataFrame
    dimensions: Mapping[str, tuple[DataFrame, tuple[str, ...]]]  # by key: the table and its categories
    width: int
    target: str
    apart: tuple[int, int] = (0, 0)

    @property
    def narrow(self) -> int:
        """Columns of the driver's solve."""
        return self.width - (self.apart[1] - self.apart[0])

    def solvable(self) -> Design:
        """The design itself; an error if its columns are too many for a solve."""
        if self.narrow > WIDEST:
            raise TooWide(f"{self.narrow} columns beside the widest category are too many for one solve (at most {WIDEST}); hash or bin the wide categories")
        return self

    def number(self, name: str) -> Column:
        return F.col(name).cast("double") - self.origin[self.numbers.index(name)]


def design(
    rows: DataFrame, stores: DataFrame, products: DataFrame, spec: FeatureSpec = FeatureSpec(), origin: Sequence[float] | None = None
) -> Design:
    """The columns for enriched rows. ``origin``: by default each number's rounded mean, which keeps the sums well scaled."""
    if origin is None:
        means = rows.agg(*[F.round(F.avg(c)).alias(c) for c in spec.numeric]).first()
        origin = [float(m or 0.0) for m in means]
    dimensions = {"store_id": (stores, spec.store_categories), "product_id": (products, spec.product_categories)}
    first, tables, spans = 1 + len(spec.numeric), [], [(0, 0)]
    for dim, columns in dimensions.values():
        if not columns:
            continue
        encoder = fit_index(dim, columns, spec.invalid)
        starts = {}
        for c in columns:
            starts[c] = first
            first += encoder.slots(c)
            spans.append((starts[c], first))
        start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("feature")]
        tables.append(encoder.table.select("feature", "value", (start + F.col("slot")).cast("int").alias("slot")))
    apart = max(spans, key=lambda s: s[1] - s[0]) if first > WIDEST else (0, 0)
    empty = rows.sparkSession.createDataFrame([], "feature string, value string, slot int")
    slots = empty
    for t in tables:
        slots = slots.unionByName(t)
    return Design(tuple(spec.numeric), tuple(origin), stage(slots, "slots"), dimensions, first, spec.target, apart)


def _slots_of(key: str, made: Design) -> DataFrame:
    """``(key, slot)``: the slots of each row of a dimension."""
    dim, columns = made.dimensions[key]
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    if not cells:
        return dim.select(key, F.lit(0).alias("slot")).limit(0)
    return dim.select(key, F.inline(F.array(*cells))).join(made.slots, ["feature", "value"]).select(key, "slot")


def equation_sums(rows: DataFrame, made: Design, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, a, b, total)`` with ``a <= b``: sums of products of columns over enriched rows with a target.

    Column 0 is the constant, then the numbers and slots; column ``width`` is the target, so ``(0, 0)`` counts rows and
    ``(width, width)`` is the sum of squared targets. Sums of categories that never meet are left out. ``by``: columns of
    the rows, for a set of sums each. The rows are read twice: for sums by store and product, and for those of numbers.
    """
    y, by = F.col(made.target).cast("double"), list(by)
    rows = rows.where(F.col(made.target).isNotNull())
    plain = {0: F.lit(1.0)} | {i: made.number(c) for i, c in enumerate(made.numbers, 1)} | {made.width: y}
    with_sums = [F.sum(e).alias(f"_s{i}") for i, e in plain.items()]
    pairs = rows.groupBy(*by, "store_id", "product_id").agg(*with_sums)
    pairs = stage(pairs, "pair-sums")

    def cells(entries: Sequence[tuple[Column, Column, Column]]) -> Column:
        kinds = ("int", "int", "double")
        return F.inline(
            F.array(*[F.struct(*[e.cast(k).alias(n) for e, k, n in zip(x, kinds, ("a", "b", "total"))]) for x in entries])
        )

    squares = [(i, j) for i in plain for j in plain if i <= j]
    numeric = rows.groupBy(*by).agg(*[F.sum(plain[i] * plain[j]).alias(f"_{i}_{j}") for i, j in squares])
    out = [numeric.select(*by, cells([(F.lit(i), F.lit(j), F.col(f"_{i}_{j}")) for i, j in squares]))]
    slots_of = {key: stage(_slots_of(key, made), "slots-by-key") for key in made.dimensions}
    for key, slots in slots_of.items():
        sums = [F.sum(f"_s{i}").alias(f"_s{i}") for i in plain]
        one = stage(pairs.groupBy(*by, key).agg(*sums), "key-sums")
        single = one.join(slots, key).groupBy(*by, "slot").agg(*sums)
        out.append(single.select(*by, cells([(F.least(F.lit(i), "slot"), F.greatest(F.lit(i), "slot"), F.col(f"_s{i}")) for i in plain])))
        a, b = slots.select(key, F.col("slot").alias("a")), slots.select(key, F.col("slot").alias("b"))
        met = one.select(*by, key, "_s0").join(a, key).join(b, key).where("a <= b")
        out.append(met.groupBy(*by, "a", "b").agg(F.sum("_s0").alias("total")))
    half = pairs.join(slots_of["product_id"], "product_id").groupBy(*by, "store_id", F.col("slot").alias("b"))
    half = half.agg(F.sum("_s0").alias("_s0")).join(slots_of["store_id"], "store_id")
    cross = half.groupBy(*by, F.col("slot").alias("a"), "b").agg(F.sum("_s0").alias("total"))
    out.append(cross)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def solve(gram: np.ndarray, moment: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
    """Least-squares coefficients; 0 for columns that depend on others, found by pivots on the scaled matrix.

    ``squares``: the columns' sums of squares, where ``gram`` holds what other columns have left of them.
    """
    scale = np.sqrt(np.maximum(np.diag(gram) if squares is None else squares, 0))
    scale[scale == 0] = 1
    g = gram / np.outer(scale, scale)
    left, rows, used = np.diag(g).copy(), np.zeros_like(g), []
    while len(used) < len(g) and left.max() > ALIKE:
        p, done = int(left.argmax()), rows[: len(used)]
        row = rows[len(used)] = (g[p] - done[:, p] @ done) / np.sqrt(left[p])
        left = left - row**2
        left[[*used, p]] = 0
        used.append(p)
    out = np.zeros(len(g))
    out[used] = np.linalg.solve(g[np.ix_(used, used)], (moment / scale)[used]) / scale[used]
    return out


@dataclass(frozen=True)
class Equations:
    """Normal equations on the driver: ``gram`` and ``moment`` of the columns, ``n`` rows, ``square`` of the target."""

    gram: np.ndarray
    moment: np.ndarray
    n: float
    square: float

    def __add__(self, other: Equations) -> Equations:
        return Equations(self.gram + other.gram, self.moment + other.moment, self.n + other.n, self.square + other.square)


def named_sums(sums: DataFrame, made: Design) -> DataFrame:
    """``(*by, a, b, total)`` with names for columns: ``1``, a number's name, ``feature=value`` or the target; ``a <= b``."""
    spark = made.slots.sparkSession
    plain = [(0, "1"), *[(i, c) for i, c in enumerate(made.numbers, 1)], (made.width, made.target)]
    names = made.slots.select("slot", F.concat_ws("=", "feature", "value").alias("name"))
    names = names.unionByName(spark.createDataFrame(plain, "slot int, name string"))
    side = lambda k: names.select(F.col("slot").alias(k), F.col("name").alias(f"_{k}"))
    out = sums.join(side("a"), "a").join(side("b"), "b").drop("a", "b")
    out = out.withColumns({"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")})
    return out.select(*[c for c in out.columns if c not in ("_a", "_b", "total", "a", "b")], "a", "b", "total")


def collect_equations(sums: DataFrame, width: int) -> Equations:
    """From :func:`equation_sums` without ``by``: at most ``width ** 2 / 2`` numbers reach the driver."""
    got = sums.select("a", "b", "total").toArrow()
    a, b, total = (got[c].to_numpy() for c in ("a", "b", "total"))
    full = np.zeros((width + 1, width + 1))
    full[a, b] = total
    full = np.maximum(full, full.T) + np.minimum(full, full.T) - np.diag(np.diag(full))
    return Equations(full[:width, :width], full[:width, width], full[0, 0], full[width, width])


@dataclass(frozen=True)
class LinearEffects:
    """A fitted model: ``intercept``, a slope per number, and ``effects``, a table ``(feature, value, effect)``."""

    intercept: float
    slopes: Mapping[str, float]
    effects: DataFrame
    dimensions: Mapping[str, tuple[DataFrame, tuple[str, ...]]]

    def predict(self, rows: DataFrame, name: str = "linear") -> DataFrame:
        """Adds the prediction to enriched rows. A category that was not fitted has no effect; a NULL number gives NULL.

        The effects of a store's or product's categories are summed in the dimension, so rows get them by two joins.
        """
        out = rows
        total = F.lit(self.intercept)
        for c, slope in self.slopes.items():
            total = total + F.lit(slope) * F.col(c).cast("double")
        for i, (key, (dim, columns)) in enumerate(self.dimensions.items()):
            if not columns:
                continue
            cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
            of_key = dim.select(key, F.inline(F.array(*cells))).join(self.effects, ["feature", "value"], "left")
            of_key = of_key.groupBy(key).agg(F.coalesce(F.sum("effect"), F.lit(0.0)).alias(f"_effect{i}"))
            out, total = out.join(of_key, key, "left"), total + F.coalesce(F.col(f"_effect{i}"), F.lit(0.0))
        return out.withColumn(name, total).select(*rows.columns, name)


def fitted(made: Design, equations: Equations) -> LinearEffects:
    """Solve the equations and name the coefficients."""
    return named_effects(made, solve(equations.gram, equations.moment))


def named_effects(made: Design, weights: np.ndarray, apart: DataFrame | None = None) -> LinearEffects:
    """The model of a coefficient per column; those of slots that are solved apart come from ``apart`` (slot, effect)."""
    n = len(made.numbers)
    slopes = {c: float(w) for c, w in zip(made.numbers, weights[1 : n + 1])}
    intercept = float(weights[0]) - sum(slopes[c] * o for c, o in zip(made.numbers, made.origin))
    spark = made.slots.sparkSession
    held = [i for i in range(n + 1, made.width) if not made.apart[0] <= i < made.apart[1]]
    values = spark.createDataFrame([(int(i), float(weights[i])) for i in held], "slot int, effect double")
    if apart is not None:
        values = values.unionByName(apart)
    named = made.slots.join(values, "slot", "left").select("feature", "value", F.coalesce("effect", F.lit(0.0)).alias("effect"))
    effects = stage(named, "effects")
    return LinearEffects(intercept, slopes, effects, made.dimensions)


def _sides(made: Design) -> tuple[Column, Column]:
    """Whether the columns ``a`` and ``b`` of the sums are slots of the category that is solved apart."""
    inside = lambda c: (F.col(c) >= made.apart[0]) & (F.col(c) < made.apart[1])
    return inside("a"), inside("b")


def apart_sums(sums: DataFrame, made: Design) -> DataFrame:
    """``(slot, n, columns, totals)`` of each slot that is solved apart: its rows, and its sums with the other columns.

    These are numbered as if the category were not there, the target last. Slots that meet each other, as where a store has
    two codes, cannot be told apart so: an error.
    """
    in_a, in_b = _sides(made)
    lo, hi = made.apart
    rows = sums.where(in_a | in_b).withColumns({"slot": F.when(in_a, F.col("a")).otherwise(F.col("b")), "_o": F.when(in_a, F.col("b")).otherwise(F.col("a"))})
    rows = rows.withColumn("_own", in_a & in_b)
    other = F.when(F.col("_o") >= hi, F.col("_o") - (hi - lo)).otherwise(F.col("_o"))
    cell = F.when(~F.col("_own"), F.struct(other.cast("int").alias("c"), F.col("total").alias("t")))
    out = rows.groupBy("slot").agg(F.sum(F.when(F.col("_own"), F.col("total"))).alias("n"), F.collect_list(cell).alias("_cells"))
    return out.select("slot", "n", F.col("_cells.c").alias("columns"), F.col("_cells.t").alias("totals"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(slots, n, sums) of rows of :func:`apart_sums`, the sums dense, in blocks of at most ``CELLS`` numbers."""
    for batch in batches:
        step = max(1, CELLS // width)
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            lengths = np.diff(part.column(2).offsets.to_numpy())
            dense = np.zeros((part.num_rows, width))
            dense[np.repeat(np.arange(part.num_rows), lengths), part.column(2).flatten().to_numpy()] = part.column(3).flatten().to_numpy()
            yield part.column(0), part.column(1).to_numpy(), dense


def eliminated(apart: DataFrame, width: int) -> np.ndarray:
    """What the slots of :func:`apart_sums` take from the equations of the other ``width`` columns, the target the last.

    A task sends on one matrix, as rows of its upper half.
    """

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((width, width))
        for _, n, sums in _blocks(batches, width):
            scaled = sums / np.sqrt(n)[:, None]
            whole += scaled.T @ scaled
        for a in np.flatnonzero(whole.any(axis=1)):
            b = a + np.flatnonzero(whole[a, a:])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a, np.int32)), pa.array(b.astype(np.int32)), pa.array(whole[a, b])], names=["a", "b", "total"])

    got = apart.mapInArrow(taken, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((width, width))
    out[got["a"].to_numpy(), got["b"].to_numpy()] = got["total"].to_numpy()
    return out + np.triu(out, 1).T


def apart_effects(apart: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(slot, n, effect)`` of the slots of :func:`apart_sums`, given the coefficients of all other columns."""
    taken = np.append(-weights, 1.0)  # of the sum of the target

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slots, n, sums in _blocks(batches, len(taken)):
            yield pa.RecordBatch.from_arrays([slots, pa.array(n), pa.array(sums @ taken / n)], names=["slot", "n", "effect"])

    return apart.mapInArrow(effects, "slot int, n double, effect double")


def fit_sums(sums: DataFrame, made: Design) -> LinearEffects | None:
    """The model of staged :func:`equation_sums` without ``by``, with a category solved apart; None where they are of no rows.

    If every row has a value of that category, its effects are taken about their mean over the rows, which is the constant,
    so that a value never seen counts as an average one.
    """
    (in_a, in_b), (lo, hi), width = _sides(made), made.apart, made.narrow
    if not sums.where(in_a & in_b & (F.col("a") != F.col("b"))).isEmpty():
        raise TooWide("rows with two values of the widest category have no solution by value; hash or bin it")
    renamed = {c: F.when(F.col(c) >= hi, F.col(c) - (hi - lo)).otherwise(F.col(c)).cast("int") for c in ("a", "b")}
    rest = collect_equations(sums.where(~in_a & ~in_b).withColumns(renamed), width)
    if not rest.n:
        return None
    apart = stage(apart_sums(sums, made), "apart-sums")
    gone = eliminated(apart, width + 1)
    weights = solve(rest.gram - gone[:width, :width], rest.moment - gone[:width, width], np.diag(rest.gram))
    effects = stage(apart_effects(apart, weights), "apart-effects")
    n, mean = effects.agg(F.sum("n"), F.sum(F.col("n") * F.col("effect")) / F.sum("n")).first()
    if n == rest.n:
        weights[0] += mean
        effects = effects.withColumn("effect", F.col("effect") - mean)
    full = np.concatenate([weights[:lo], np.zeros(hi - lo), weights[lo:]])
    return named_effects(made, full, effects.select("slot", "effect"))


def fit_linear(
    flagged: DataFrame, stores: DataFrame, products: DataFrame, spec: FeatureSpec = FeatureSpec(), as_of_year: int | None = None
) -> LinearEffects:
    """Least squares on the train rows (``is_train``) of a panel: date parts, store and product categories."""
    if spec.hashed:
        raise TooWide("hashed categories have no sums by value; use regressors.linear")
    with working() as keep:
        rows = enrich(flagged.where("is_train"), stores, products, as_of_year)
        made = design(rows, stores, products, spec).solvable()
        if made.apart == (0, 0):
            model = fitted(made, collect_equations(equation_sums(rows, made), made.width))
        else:  # without rows: the model that says 0
            model = fit_sums(stage(equation_sums(rows, made), "sums"), made) or named_effects(made, np.zeros(made.width))
        keep(model.effects)
    return model


def linear_errors(
    flagged: DataFrame, stores: DataFrame, products: DataFrame, spec: FeatureSpec = FeatureSpec(), as_of_year: int | None = None
) -> DataFrame:
    """``(model, split, n_rows, n_scored, rmse)`` of :func:`fit_linear` on a staged, flagged panel."""
    with working() as keep:
        model = fit_linear(flagged, stores, products, spec, as_of_year)
        scored = model.predict(enrich(flagged, stores, products, as_of_year))
        split = F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test"))
        errors = rmse(scored.withColumn("split", split), spec.target, "linear", ["split"])
        return keep(stage(errors.select(F.lit("linear").alias("model"), "split", "n_rows", "n_scored", "rmse"), "linear-errors"))


def rolling_linear_scores(
    panel: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    n_folds: int = 4,
    test_days: int = 90,
    gap_days: int = 30,
    as_of_year: int | None = None,
) -> DataFrame:
    """``(fold, n_rows, n_scored, rmse)`` of a linear model fitted on each fold's own past.

    Folds are those of :func:`tidemark.operators.split.fold_bounds`. A fold's past is that of the fold before and some days
    more, so the sums are taken once by the fold whose past a row first belongs to, and a fold's equations are the running
    sum of those. A fold without past rows scores nothing. Rows without a date belong to every past, as in the split.
    """
    with working() as keep:
        last = panel.agg(F.max("date").alias("last")).scalar()
        rows = stage(enrich(panel, stores, products, as_of_year), "fold-rows")
        age = F.datediff(last, F.col("date"))
        # the past of fold k ends (n_folds - k + 1) * test_days + gap_days days before the last
        past = F.when(F.col("date").isNull(), 1).otherwise(
            F.greatest(F.lit(1), n_folds + 1 - F.floor((age - gap_days) / test_days))
        )
        blocks = rows.withColumn("_block", past.cast("int"))
        made = design(rows, stores, products, spec).solvable()
        sums = stage(equation_sums(blocks.where(F.col("_block") <= n_folds), made, ["_block"]), "fold-sums")
        test = F.when((age >= 0) & (age < n_folds * test_days), n_folds - F.floor(age / test_days)).cast("int")
        tested = rows.withColumn("fold", test).where("fold IS NOT NULL")
        so_far, scored = None, None
        for fold in range(1, n_folds + 1):
            if made.apart == (0, 0):
                now = collect_equations(sums.where(F.col("_block") == fold), made.width)
                so_far = now if so_far is None else so_far + now
                model = fitted(made, so_far) if so_far.n else None
            else:
                past_sums = sums.where(F.col("_block") <= fold).groupBy("a", "b").agg(F.sum("total").alias("total"))
                model = fit_sums(stage(past_sums, "past-sums"), made)
            part = tested.where(F.col("fold") == fold)
            part = model.predict(part) if model else part.withColumn("linear", F.lit(None).cast("double"))
            part = part.select("fold", spec.target, "linear")
            scored = part if scored is None else scored.unionByName(part)
        return keep(stage(rmse(scored, spec.target, "linear", ["fold"]), "fold-scores"))
