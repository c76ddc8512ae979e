"""Category encoders whose state is a table, for columns of any width.

The fitted state is a parquet table ``(feature, value, slot)``. Rows get their slots by joining it, one left join a column,
so no category is held on the driver: Spark broadcasts a small part of the table by its size and shuffles a wide one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indexing import category_index
from tidemark.runtime import stage

INVALID = ("error", "keep", "skip", "default")


class TableEncoder(Transformer, MLReadable, MLWritable):
    """Adds ``<column><suffix>``, the slot of each category as a double, by joins with ``table``.

    A value that the table does not have, NULL included, is an error, takes a slot of its own after all others (``keep``),
    drops the row (``skip``) or takes the column's default slot (``default``). With ``nominal`` the new columns carry their
    number of slots as ML metadata, so one-hot encoders and trees know them as categories without a list of values;
    otherwise they are plain ordered numbers. Columns are matched as strings. Repeated rows of a table are not allowed.
    """

    columns = Param(Params._dummy(), "columns", "category columns", TypeConverters.toListString)
    widths = Param(Params._dummy(), "widths", "slots of each column, without that of unseen values", TypeConverters.toListInt)
    defaults = Param(Params._dummy(), "defaults", "slot of unseen values of each column", TypeConverters.toListInt)
    suffix = Param(Params._dummy(), "suffix", "ending of the new columns", TypeConverters.toString)
    invalid = Param(Params._dummy(), "invalid", "treatment of unseen values", TypeConverters.toString)
    nominal = Param(Params._dummy(), "nominal", "whether slots are categories", TypeConverters.toBoolean)

    def __init__(self, table: DataFrame | None = None, **settings: Any):
        super().__init__()
        self.table = table
        self._setDefault(columns=[], widths=[], defaults=[], suffix="_index", invalid="error", nominal=True)
        self._set(**settings)
        if self.getOrDefault("invalid") not in INVALID:
            raise ValueError(f"invalid must be one of {INVALID}, not {self.getOrDefault('invalid')!r}")

    def slots(self, column: str) -> int:
        """How many slots a column has, with the one that ``keep`` adds."""
        at = self.getOrDefault("columns").index(column)
        return self.getOrDefault("widths")[at] + (self.getOrDefault("invalid") == "keep")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        invalid, suffix = self.getOrDefault("invalid"), self.getOrDefault("suffix")
        out = dataset
        for i, c in enumerate(self.getOrDefault("columns")):
            part = self.table.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("slot").alias("_slot"))
            out = out.join(part, out[c].cast("string") == part["_value"], "left")
            slot = F.col("_slot").cast("double")
            if invalid == "error":
                unseen = F.concat(F.lit(f"no slot for {c} = "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))
                slot = F.coalesce(slot, F.raise_error(unseen).cast("double"))
            elif invalid == "keep":
                slot = F.coalesce(slot, F.lit(float(self.getOrDefault("widths")[i])))
            elif invalid == "default":
                slot = F.coalesce(slot, F.lit(float(self.getOrDefault("defaults")[i])))
            else:
                out = out.where("_slot IS NOT NULL")
            name = f"{c}{suffix}"
            if self.getOrDefault("nominal"):
                slot = slot.alias(name, metadata={"ml_attr": {"type": "nominal", "name": name, "num_vals": self.slots(c)}})
            else:
                slot = slot.alias(name)
            out = out.select(*[x for x in out.columns if x not in ("_value", "_slot", name)], slot)
        return out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: TableEncoder):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.select("feature", "value", "slot").write.parquet(f"{path}/table")


class _Reader(MLReader):
    def load(self, path: str) -> TableEncoder:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = TableEncoder(self.sparkSession.read.parquet(f"{path}/table"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


def fit_index(dim: DataFrame, columns: Sequence[str], invalid: str = "error", suffix: str = "_index") -> TableEncoder:
    """An encoder of each column's values by frequency, ties by value (:func:`category_index`); its table is staged."""
    table = stage(category_index(dim, columns).select("feature", "value", F.col("idx").alias("slot")), "categories")
    counted = {r.feature: r.n for r in table.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # a row a column
    widths = [counted.get(c, 0) for c in columns]
    return TableEncoder(table, columns=list(columns), widths=widths, suffix=suffix, invalid=invalid)


def fit_slots(table: DataFrame, widths: Mapping[str, int], defaults: Mapping[str, int], suffix: str) -> TableEncoder:
    """An encoder to ordered numbers from a staged ``(feature, value, slot)`` table, with a default for unseen values."""
    columns = list(widths)
    return TableEncoder(
        table,
        columns=columns,
        widths=[widths[c] for c in columns],
        defaults=[defaults[c] for c in columns],
        suffix=suffix,
        invalid="default",
        nominal=False,
    )
