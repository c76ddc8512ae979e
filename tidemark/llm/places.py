"""Identity of rows: where a row lies in the files it is read from.

Ids may be NULL or repeated and texts may be equal, so a stage that decides row by row needs a mark that no two rows share
and that stays the same however often the table is read. Parquet gives one, file and row number in it, without a copy.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import stage


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the same with underscores before it if the table has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def placed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, a struct of two numbers, and that column's name.

    A table as read from files keeps its rows where they are; any other frame is staged first (under ``label``), since its
    rows may come out in another order the next time. The file counts as a 64-bit hash of its path.
    """
    name = free_name(docs, "place")

    def mark(table: DataFrame) -> DataFrame:
        meta = table.metadataColumn("_metadata")
        place = F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"))
        return table.select("*", place.alias(name))

    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":  # a scan and nothing above it
        try:
            return mark(docs), name
        except AnalysisException:  # files that do not number their rows
            pass
    return mark(stage(docs, label)), name
