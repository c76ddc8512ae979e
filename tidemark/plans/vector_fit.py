"""Least squares by iteration over feature vectors, for many rows and wide one-hot vectors.

The loss of a block of rows is a quadratic whose matrix holds what its vectors say: the products of their columns. Rows that
share most columns, such as those of some stores, have far fewer products than numbers, so a block is read once, kept as its
products (or as its vectors, where these are fewer numbers), and every iteration goes over the blocks. A task of an
iteration sends on the slots that its blocks have, not one number a slot.

The iteration is that of ``pyspark.ml``: L-BFGS on standardised columns with the same line search and the same tests of
convergence. A quadratic needs one pass an iteration however many steps its line search tries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.wrapper import _py2java
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import stage, unstage

BLOCK_ROWS = 1 << 17  # rows of a block, which a task holds
BLOCK_SLOTS = 1024  # slots of a block whose products are formed: 8 MB
HELD = 1 << 23  # numbers of all blocks that the driver iterates over by itself: 134 MB
TASK = 1 << 21  # numbers of a task of an iteration: 34 MB
BLOCK = "n long, y0 double, y1 double, y2 double, slots array<int>, shift array<double>, sums array<double>, squares array<double>, moments array<double>, a array<int>, b array<int>, v array<double>, products boolean"
MEMORY = 10  # steps that L-BFGS keeps, as pyspark.ml
WINDOW = 20  # values of the loss that are compared for convergence, as pyspark.ml


class VectorRegression(LinearRegression):
    """``LinearRegression`` whose ``l-bfgs`` solver goes over blocks of vectors (:func:`block_rows`); the coefficients are the
    same but for rounding. With a penalty, weights, another loss or solver, or without an intercept it is Spark's own."""

    def _fit_java(self, dataset: DataFrame):
        plain = self.getSolver() == "l-bfgs" and self.getLoss() == "squaredError" and self.getFitIntercept() and not self.getRegParam()
        if not plain or self.isSet("weightCol"):
            return super()._fit_java(dataset)
        self._transfer_params_to_java()
        jvm = dataset.sparkSession._jvm
        weights, intercept = fit_vectors(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getMaxIter(), self.getTol())
        coefficients = _py2java(dataset.sparkSession.sparkContext, Vectors.dense(weights))
        model = jvm.org.apache.spark.ml.regression.LinearRegressionModel(self.uid, coefficients, float(intercept))
        return self._java_obj.copyValues(model, jvm.org.apache.spark.ml.param.ParamMap())


def fit_vectors(rows: DataFrame, features: str, label: str, max_iter: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """Coefficients and intercept. Rows of equal wide categories should lie together; any order gives the same."""
    width = _width(rows, features)
    blocks = stage(block_rows(rows, features, label), "vector-blocks")
    try:
        return _fitted(blocks, width, max_iter, tol)
    finally:
        unstage(blocks)


def _width(rows: DataFrame, features: str) -> int:
    known = rows.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if known is None:
        first = rows.select(features).first()
        if first is None:
            raise ValueError("no rows to fit")
        known = first[0].size
    return int(known)


def block_rows(rows: DataFrame, features: str, label: str) -> DataFrame:
    """A row per block of vectors and targets (``BLOCK``).

    ``slots``: the columns that the block has, each less its ``shift`` (0 for those that some row lacks); ``sums``,
    ``squares`` and ``moments``: their sums, of themselves, squared and times the target, which is less ``y0`` and has the
    sums ``y1`` and ``y2``. ``a, b, v``: the upper half of the products of places in ``slots``, or the vectors themselves
    as row, place and number.
    """
    x, y = F.unwrap_udt(features), F.col(label).cast("double")
    cells = F.when(x["type"] == 0, x["indices"]).otherwise(F.sequence(F.lit(0), F.size(x["values"]) - 1))
    cells = F.when(F.size(x["values"]) == 0, F.array().cast("array<int>")).otherwise(cells)
    wrong = F.raise_error(F.lit("Labels MUST NOT be Null or NaN")).cast("double")
    target = F.when(y.isNull() | F.isnan(y), wrong).otherwise(y)
    return rows.select(cells.alias("i"), x["values"].alias("x"), target.alias("y")).mapInArrow(_blocks, BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, slots, n = [], np.zeros(0, np.int64), 0
    for part in _parts(batches):
        own = np.unique(part[1])
        both = np.union1d(slots, own)
        if held and (n + len(part[0]) > BLOCK_ROWS or len(both) > BLOCK_SLOTS):
            yield _block(held, slots)
            held, both, n = [], own, 0
        held, slots, n = [*held, part], both, n + len(part[0])
    if held:
        yield _block(held, slots)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of each row, their slots, their values, targets), halved until the slots are few or the rows are."""
    for batch in batches:
        todo = [batch] if batch.num_rows else []
        while todo:
            part = todo.pop()
            lengths = np.diff(part.column(0).offsets.to_numpy())
            at, x = part.column(0).flatten().to_numpy(), part.column(1).flatten().to_numpy()
            if not np.isfinite(x).all():
                raise ValueError("vectors must not hold NaN or infinite values")
            if part.num_rows > 64 and len(np.unique(at)) > BLOCK_SLOTS:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield lengths, at.astype(np.int64), x, part.column(2).to_numpy()


def _block(held: list, slots: np.ndarray) -> pa.RecordBatch:
    n, wide = sum(len(p[0]) for p in held), len(slots)
    count, shift = np.zeros(wide), np.zeros(wide)
    local = [np.searchsorted(slots, at) for _, at, _, _ in held]
    for at in local:
        count += np.bincount(at, minlength=wide)
    first = held[0][0][0]
    shift[local[0][:first]] = held[0][2][:first]  # a column that all rows have is taken from its first value on
    shift[count < n] = 0.0
    y0 = held[0][3][0]
    sums, squares, moments, y1, y2 = np.zeros(wide), np.zeros(wide), np.zeros(wide), 0.0, 0.0
    numbers = sum(len(at) for at in local)
    formed = wide <= BLOCK_SLOTS
    products = np.zeros(wide * wide if formed else 0)
    vectors, row0 = [], 0
    for (lengths, _, x, y), at in zip(held, local):
        x, y = x - shift[at], y - y0
        row = np.repeat(np.arange(len(lengths)), lengths)
        sums += np.bincount(at, x, wide)
        squares += np.bincount(at, x * x, wide)
        moments += np.bincount(at, x * y[row], wide)
        y1, y2 = y1 + y.sum(), y2 + y @ y
        vectors.append((row + row0, at, x))
        row0 += len(lengths)
        start = np.cumsum(lengths) - lengths
        for k in np.unique(lengths) if formed else ():  # rows with as many numbers
            of_rows = start[lengths == k]
            step = max(1, (1 << 21) // max(1, k * k))
            for i in range(0, len(of_rows), step) if k else ():
                cells = of_rows[i : i + step, None] + np.arange(k)
                p, q = np.triu_indices(k)
                a, b, v = at[cells], at[cells], x[cells]
                products += np.bincount((a[:, p] * wide + b[:, q]).ravel(), (v[:, p] * v[:, q]).ravel(), wide * wide)
    filled = np.flatnonzero(products)
    formed = formed and len(filled) < numbers
    if formed:
        a, b, v = filled // wide, filled % wide, products[filled]
    else:
        a, b, v = (np.concatenate(parts) for parts in zip(*vectors))
    ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
    lists = [(slots, ints), (shift, doubles), (sums, doubles), (squares, doubles), (moments, doubles), (a, ints), (b, ints), (v, doubles)]
    plain = [pa.array([n], pa.int64()), *[pa.array([float(z)]) for z in (y0, y1, y2)]]
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(z)], pa.int32()), pa.array(z, kind.value_type)) for z, kind in lists]
    return pa.RecordBatch.from_arrays([*plain, *arrays, pa.array([formed])], names=[c.split()[0] for c in BLOCK.split(", ")])


def _numbers(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch, lists as arrays."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        yield {c: (z.flatten().to_numpy() if pa.types.is_list(z.type) else z[0].as_py()) for c, z in zip(row.schema.names, row.columns)}


class _Passes:
    """Sums over blocks: by tasks of Spark, or here where the blocks are few numbers in all."""

    def __init__(self, blocks: DataFrame):
        size = blocks.agg(F.sum(F.size("v") + 3 * F.size("slots"))).first()[0] or 0
        self.blocks = blocks.coalesce(1 + size // TASK)
        self.here = blocks.toArrow() if size <= HELD else None

    def total(self, adds: Callable[[dict, np.ndarray], None], length: int, *columns: str) -> np.ndarray:
        """The array of ``length`` numbers that ``adds`` fills from every block's ``columns``."""

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(length)
            for batch in batches:
                for block in _numbers(batch):
                    adds(block, out)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["slot", "total"])

        if self.here is not None:
            got = next(summed(self.here.select(list(columns)).to_batches()))
        else:
            parts = self.blocks.select(*columns).mapInArrow(summed, "slot int, total double")
            got = parts.groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        out = np.zeros(length)
        out[got["slot"].to_numpy()] = got["total"].to_numpy()
        return out


def _fitted(blocks: DataFrame, width: int, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    passes = _Passes(blocks)

    def first(z, out):
        s = z["slots"]
        out[s] += z["sums"] + z["n"] * z["shift"]
        out[width + s] += z["n"]
        out[2 * width :] += (z["n"], z["y1"] + z["n"] * z["y0"])

    got = passes.total(first, 2 * width + 2, "n", "y0", "y1", "slots", "shift", "sums")
    n, has = got[-2], got[width : 2 * width]
    if not n:
        raise ValueError("no rows to fit")
    mean, y_mean = got[:width] / n, got[-1] / n

    def second(z, out):
        s, off, up = z["slots"], z["shift"] - mean[z["slots"]], z["y0"] - y_mean
        rest = z["y1"] + z["n"] * up
        out[s] += z["moments"] + z["sums"] * up + z["shift"] * rest
        out[width + s] += z["squares"] + 2 * z["sums"] * off + z["n"] * off**2
        out[2 * width :] += (rest, z["y2"] + 2 * z["y1"] * up + z["n"] * up**2)

    got = passes.total(second, 2 * width + 2, "n", "y0", "y1", "y2", "slots", "shift", "sums", "squares", "moments")
    moment, spread, square = got[:width] - mean * got[-2], got[width : 2 * width] + (n - has) * mean**2, got[-1]
    y_std = np.sqrt(square / (n - 1)) if n > 1 else 0.0
    if not y_std:
        return np.zeros(width), y_mean
    std = np.sqrt(spread / (n - 1))
    inverse = np.divide(1.0, std, out=np.zeros(width), where=std > 1e-9 * np.abs(mean))

    def product(d: np.ndarray) -> np.ndarray:
        """The standardised matrix times ``d``."""
        w = inverse * d
        past = float(mean @ w)

        def adds(z, out):
            s, of = z["slots"], w[z["slots"]]
            away = float(z["shift"] @ of) - past
            whole = float(z["sums"] @ of) + z["n"] * away
            a, b, v = z["a"], z["b"], z["v"]
            if z["products"]:
                inner = np.bincount(a, v * of[b], len(s)) + np.bincount(b, np.where(a == b, 0.0, v) * of[a], len(s))
            else:
                inner = np.bincount(b, v * np.bincount(a, v * of[b], z["n"])[a], len(s))
            out[s] += inner + z["sums"] * away + z["shift"] * whole
            out[width] += whole

        got = passes.total(adds, width + 1, "n", "slots", "shift", "sums", "a", "b", "v", "products")
        return inverse * (got[:width] - mean * got[width]) / n

    weights = minimum(product, inverse * moment / (n * y_std), square / (n * y_std**2), max_iter, tol) * inverse * y_std
    return weights, y_mean - float(mean @ weights)


class _NoStep(Exception):
    """The line search found no step along the direction."""


def minimum(product: Callable[[np.ndarray], np.ndarray], moment: np.ndarray, constant: float, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Where ``(x @ product(x) - 2 * moment @ x + constant) / 2`` is least, by L-BFGS from 0 as ``pyspark.ml`` runs it."""
    x, value, grad = np.zeros(len(moment)), constant / 2, -moment
    initial, window, steps, i, failed = value, [np.inf], [], 0, False
    while True:
        if 0 <= max_iter <= i or (len(window) > 1 and abs(value - max(window)) <= tol * initial):
            return x
        if np.linalg.norm(grad) <= max(tol * value, 1e-8):
            return x
        try:
            down = _direction(grad, steps)
            taken = product(down)
            slope, curve = grad @ down, down @ taken
            t = _step(value, slope, curve, 1.0 / np.linalg.norm(down) if i == 0 else 1.0)
            if t * np.linalg.norm(grad) < 1e-10:
                raise _NoStep
        except _NoStep:
            if failed:
                return x
            failed, steps = True, []
            continue
        failed = False
        steps = [(t * down, t * taken), *steps][:MEMORY]
        x, grad, value = x + t * down, grad + t * taken, value + t * slope + t * t * curve / 2
        window, i = [*window, value][-WINDOW:], i + 1


def _direction(grad: np.ndarray, steps: list) -> np.ndarray:
    down, parts = grad.copy(), []
    for step, change in steps:
        share = (step @ down) / (step @ change)
        if np.isnan(share):
            raise _NoStep
        parts.append(share)
        down -= share * change
    if steps:
        step, change = steps[0]
        scale = (step @ change) / (change @ change)
        if np.isnan(scale) or scale < 0:
            raise _NoStep
        down *= scale
    for (step, change), share in zip(steps[::-1], parts[::-1]):
        down += (share - (change @ down) / (step @ change)) * step
    return -down


def _step(value: float, slope: float, curve: float, t: float) -> float:
    """A step that satisfies the strong Wolfe conditions on ``value + slope * t + curve * t ** 2 / 2``: brackets, then cubics."""
    if slope > 0:
        raise _NoStep

    def at(t: float) -> tuple[float, float, float]:
        return t, value + slope * t + curve * t * t / 2, slope + curve * t

    def between(l, r):  # noqa: E741
        d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        d2 = np.sqrt(d1 * d1 - l[2] * r[2])
        t = r[0] - (r[0] - l[0]) * (r[2] + d2 - d1) / (r[2] - l[2] + 2 * d2)
        low, high = l[0] + 0.1 * (r[0] - l[0]), l[0] + 0.9 * (r[0] - l[0])
        return low if t < low else high if t > high else t

    def zoom(low, high):
        for _ in range(10):
            c = at(between(high, low) if low[0] > high[0] else between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _NoStep

    low = at(0.0)
    for k in range(10):
        c = at(t)
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and k):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _NoStep
