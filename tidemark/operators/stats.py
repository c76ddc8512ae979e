"""Correlation and error measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair as rows ``(col_a, col_b, corr)``, both orders and the diagonal.

    All pairs come from one aggregate. A pair uses the rows where both columns are present; a constant column has
    no correlation (NULL).
    """
    columns = list(columns)
    values = {c: F.col(c).cast("double") for c in columns}

    def pearson(a, b):
        both = values[a].isNotNull() & values[b].isNotNull()
        x, y = F.when(both, values[a]), F.when(both, values[b])
        # merged partial deviations of a constant column need not come out as exactly 0
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    pairs = list(combinations(columns, 2))
    wide = df.agg(
        *[pearson(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)],
        *[F.when(F.min(values[c]) < F.max(values[c]), F.lit(1.0)).alias(f"self_{i}") for i, c in enumerate(columns)],
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [(a, b, F.col(f"{i}")), (b, a, F.col(f"{i}"))]
    cells += [(c, c, F.col(f"self_{i}")) for i, c in enumerate(columns)]
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), v.alias("corr")) for a, b, v in cells])
    return wide.select(F.inline(rows))


WIDEST = 4096  # columns of a matrix of sums: 400 MB in a task
TILE = 64  # columns of a side of a tile, which bounds the working space beside the sums
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def pair_sums(df: DataFrame, columns: Sequence[str], origin: Sequence[float]) -> DataFrame:
    """``(a, b, n, x, y, xx, yy, xy)`` for columns numbers ``a <= b``: sums over the rows where both are present.

    A task multiplies blocks of rows tile by tile and sends on one row per pair, so what is shuffled is ``columns ** 2``
    rows a task, and tasks are few: input splits are read one after another by twice as many tasks as there are cores.
    ``origin`` is taken off each column first, which keeps the sums small beside the deviations.
    """
    k = len(columns)
    if k > WIDEST:
        raise ValueError(f"{k} columns are too many for one matrix of sums (at most {WIDEST})")
    shift, names = np.array(origin, float), SUMS
    tiles = [(slice(i, min(i + TILE, k)), slice(j, min(j + TILE, k))) for i in range(0, k, TILE) for j in range(i, k, TILE)]

    def tile_sums(values: np.ndarray, known: np.ndarray, a: slice, b: slice) -> np.ndarray:
        x, y, in_x, in_y = values[:, a], values[:, b], known[:, a], known[:, b]
        return np.stack([in_x.T @ in_y, x.T @ in_y, in_x.T @ y, (x * x).T @ in_y, in_x.T @ (y * y), x.T @ y])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0.0] * len(tiles)
        for batch in batches:
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            known = ~np.isnan(raw)
            values, known = np.where(known, raw - shift, 0.0), known.astype(float)
            for t, (a, b) in enumerate(tiles):
                held[t] = held[t] + tile_sums(values, known, a, b)
        for total, (a, b) in zip(held, tiles):
            if isinstance(total, float):
                continue
            i, j = (x.ravel() for x in np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij"))
            upper = i <= j
            cells = [pa.array(total[s].ravel()[upper]) for s in range(len(names))]
            places = [pa.array(c[upper].astype(np.int32)) for c in (i, j)]
            yield pa.RecordBatch.from_arrays([*places, *cells], names=["a", "b", *names])

    few = df.select(*[F.col(c).cast("double") for c in columns]).coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(sums, "a int, b int, " + ", ".join(f"{s} double" for s in SUMS))
    return parts.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])


def wide_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_a, col_b, n, corr)`` like :func:`correlation_matrix`, for hundreds of columns, with the rows of each pair.

    One plan of ``columns ** 2`` aggregates does not compile beyond a few dozen columns; here the pairs are entries of a
    matrix product. NULL and NaN both count as absent; a column that does not vary over a pair's rows has no correlation.
    """
    columns = list(columns)
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(known)]).first()
    sums = pair_sums(df, columns, [m or 0.0 for m in means])
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    xx, yy = spread("x", "xx"), spread("y", "yy")
    together = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    tiny = 1e-12  # what rounding leaves of a constant column, beside its sum of squares
    varies = (F.col("n") > 1) & (xx > tiny * F.col("xx")) & (yy > tiny * F.col("yy"))
    corr = F.when(varies, F.when(F.col("a") == F.col("b"), 1.0).otherwise(together / F.sqrt(xx * yy)))
    names = F.array(*map(F.lit, columns))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)
    out = sums.select(F.explode(sides).alias("_s"), F.col("n").cast("long").alias("n"), corr.alias("corr"))
    return out.select(names[F.col("_s.a")].alias("col_a"), names[F.col("_s.b")].alias("col_b"), "n", "corr")


def variance_inflation(correlations: DataFrame, columns: Sequence[str], most: float = 10.0) -> DataFrame:
    """``(column, position, inflation, kept)``: how far each column follows from those kept before it.

    Columns are taken in the order given. A column's inflation is ``1 / (1 - R2)`` of its regression on the kept ones; over
    ``most`` it is dropped, so sums of other columns go even where no pair is alike. NULL: it follows entirely, or has no
    correlation. The matrix is swept by each kept column in turn; it is as wide as the schema and held on the driver.
    """
    place = {c: i for i, c in enumerate(columns)}
    left = np.full((len(place), len(place)), np.nan)
    for r in correlations.where(F.col("col_a").isin(list(place)) & F.col("col_b").isin(list(place))).select("col_a", "col_b", "corr").collect():
        left[place[r.col_a], place[r.col_b]] = np.nan if r.corr is None else r.corr
    out = []
    for i, c in enumerate(columns):
        pivot = left[i, i]
        inflation = float(1 / pivot) if pivot > 1e-10 else None
        kept = inflation is not None and inflation <= most * (1 + 1e-12)
        out.append((c, i, inflation, kept))
        if kept:
            left = left - np.outer(left[:, i], left[i]) / pivot
    return correlations.sparkSession.createDataFrame(out, "column string, position int, inflation double, kept boolean")


def collinear_pairs(correlations: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of different columns with an absolute correlation of at least ``threshold``, each pair once."""
    return correlations.where((F.col("col_a") < F.col("col_b")) & (F.abs("corr") >= threshold))


def keep_independent(columns: Sequence[str], pairs: DataFrame) -> list[str]:
    """The columns left when, of each collinear pair, the one named later in ``columns`` is dropped.

    ``pairs`` has at most a row per pair of *columns*, so reading it on the driver is bounded by the schema.
    """
    linked = {frozenset((r.col_a, r.col_b)) for r in pairs.collect()}
    kept: list[str] = []
    for c in columns:
        if not any(frozenset((c, k)) in linked for k in kept):
            kept.append(c)
    return kept


def rmse(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: ``n_rows``, ``n_scored`` (rows with a prediction) and the root mean squared error over those."""
    miss = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count(miss).alias("n_scored"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
    )
