"""Encoding and scaling with pyspark.ml, and the same scaling as plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import DATE_PART_NAMES
from tidemark.operators.encoders import fit_index

STORE_CATEGORIES = ("store_code", "region", "district", "city", "state")
PRODUCT_CATEGORIES = ("supplier", "product_name", "category", "sub_category")


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns a regressor sees.

    Trees take categories of at most ``tree_width`` values as such, wider ones as ``tree_bins`` bins in order of their mean
    target on the train rows (:mod:`tidemark.operators.binning`), so a category never widens their statistics.

    ``hashed`` names categories too wide for a slot per value: they are hashed into ``hash_width`` slots and leave
    the one-hot list. ``invalid`` is the treatment of NULL or unseen categories (``error``, ``keep``, ``skip``).
    """

    numeric: tuple[str, ...] = (*DATE_PART_NAMES, "years_open")
    store_categories: tuple[str, ...] = STORE_CATEGORIES
    product_categories: tuple[str, ...] = PRODUCT_CATEGORIES
    hashed: tuple[str, ...] = ()
    hash_width: int = 1024
    target: str = "qty"
    ids: tuple[str, ...] = field(default=("date", "store_id", "product_id"))
    invalid: str = "error"
    tree_width: int = 32
    tree_bins: int = 64


def vector_name(column: str) -> str:
    return f"{column}_vec"


def index_name(column: str) -> str:
    return f"{column}_index"


def bin_name(column: str) -> str:
    return f"{column}_bin"


def encode(
    dim: DataFrame, columns: Sequence[str], invalid: str = "error", keep_index: bool = False
) -> tuple[DataFrame, list[str]]:
    """One-hot vectors of a dimension's categories, and the names of the columns that have one.

    All columns are fitted together: one job for the indexes, none for the encoder. A column with a single value has
    no vector; it is skipped and not in the returned list.
    """
    stages, usable = fit_encoders(dim, columns, invalid)
    encoded = PipelineModel(stages=stages).transform(dim)
    return (encoded if keep_index else encoded.drop(*[index_name(c) for c in columns])), usable


def fit_encoders(dim: DataFrame, columns: Sequence[str], invalid: str = "error") -> tuple[list, list[str]]:
    """The fitted stages of :func:`encode`, which take any rows that have the columns, and the columns with a vector.

    The indexes come from a table (:class:`tidemark.operators.encoders.TableEncoder`), the vectors from their widths.
    """
    if not columns:
        return [], []
    indexer = fit_index(dim, columns, invalid)
    usable = [c for c in columns if indexer.slots(c) > 1]
    if not usable:
        return [indexer], []
    encoder = OneHotEncoder(inputCols=[index_name(c) for c in usable], outputCols=[vector_name(c) for c in usable])
    return [indexer, encoder.fit(indexer.transform(dim))], usable


def hash_categories(df: DataFrame, columns: Sequence[str], width: int = 1024, out: str = "hashed_vec") -> DataFrame:
    """All ``columns`` hashed into one sparse vector; no fit and no table of values, however many there are."""
    return category_hasher(columns, width, out).transform(df)


def category_hasher(columns: Sequence[str], width: int = 1024, out: str = "hashed_vec") -> FeatureHasher:
    return FeatureHasher(inputCols=list(columns), outputCol=out, numFeatures=width, categoricalCols=list(columns))


def unit_scaler(column: str, out: str = "features") -> StandardScaler:
    """Scale to unit standard deviation, without centring so that sparse vectors stay sparse.

    Scaling is per vector position, so one scaler over the assembled vector equals one scaler per column and takes
    one pass over the data.
    """
    return StandardScaler(inputCol=column, outputCol=out, withMean=False, withStd=True)


def scale_columns(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """``<c>_scaled`` = c over its sample standard deviation in ``fit_on`` (default: ``df``); 0 for a constant column."""
    source = df if fit_on is None else fit_on

    def std(c):
        value = F.col(c).cast("double")
        # merged partial deviations of a constant column need not come out as exactly 0
        return F.when(F.min(value) < F.max(value), F.stddev_samp(value)).alias(c)

    stds = source.agg(*[std(c) for c in columns]).select(F.struct(*columns).alias("s")).scalar()
    return df.withColumns(
        {
            f"{c}_scaled": F.when(F.col(c).isNotNull(), F.coalesce(F.col(c).cast("double") / stds[c], F.lit(0.0)))
            for c in columns
        }
    )
