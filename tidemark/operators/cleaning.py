"""Turning an exported sales table into typed rows, and counting what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.numbers import decimal_comma

MEASURES = ("qty", "revenue", "tax", "cost")


def clean_sales(
    raw: DataFrame,
    measures: Sequence[str] = MEASURES,
    date: str | None = "date",
    to: str | dict[str, str] = "double",
    thousands: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Decimal-comma text to numbers and ``date`` to a date, in one projection.

    ``to`` is one type for all measures (``"float"`` for 32-bit), or a type for each; decimals round to their digits
    and give NULL beyond their range, which :func:`parse_audit` counts.
    """
    kinds = _types(measures, to)
    changed = {m: decimal_comma(m, kinds[m], thousands, strict) for m in measures}
    if date:
        changed[date] = F.col(date).cast("date") if strict else F.col(date).try_cast("date")
    return raw.withColumns(changed)


def _types(measures: Sequence[str], to: str | dict[str, str]) -> dict[str, str]:
    return to if isinstance(to, dict) else dict.fromkeys(measures, to)


def parse_audit(
    raw: DataFrame, measures: Sequence[str] = MEASURES, to: str | dict[str, str] = "double", thousands: str | None = None
) -> DataFrame:
    """``(column, n_text, n_null_after, n_digits_lost)``: what :func:`clean_sales` with the same arguments would lose.

    Texts present, texts that become NULL, and numbers whose value changes. The exact value is a decimal with 18 digits
    on either side of the point, and texts beyond that count as lost. One pass for all columns.
    """
    counts = _losses(_types(measures, to), thousands)
    facts = [F.struct(F.lit(m).alias("column"), *[F.count_if(c).alias(n) for n, c in of.items()]) for m, of in counts.items()]
    return raw.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


EXACT = "decimal(36,18)"


def _losses(kinds: dict[str, str], thousands: str | None) -> dict[str, dict[str, Column]]:
    """By measure, the conditions that :func:`parse_audit` counts."""
    out = {}
    for m, kind in kinds.items():
        value, exact = decimal_comma(m, kind, thousands), decimal_comma(m, EXACT, thousands)
        same = value.try_cast(EXACT).eqNullSafe(exact) & exact.isNotNull()
        out[m] = {
            "n_text": F.col(m).isNotNull(),
            "n_null_after": F.col(m).isNotNull() & value.isNull(),
            "n_digits_lost": value.isNotNull() & ~same,
        }
    return out


def write_cleaned(
    raw: DataFrame,
    path: str,
    measures: Sequence[str] = MEASURES,
    date: str | None = "date",
    to: str | dict[str, str] = "double",
    thousands: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean, audit and write in one pass: (accepted rows, rejected rows, audit) from ``path``.

    A row is rejected if a text of a measure or of the date would become NULL or a number lose digits; it is written as it
    came, with ``reasons``, the columns at fault. Accepted rows are those of :func:`clean_sales`. The audit is that of
    :func:`parse_audit`, with a row for the date, counted while the rows are written (``DataFrame.observe``), and ``n_rows``
    and ``n_rejected`` beside it. Both tables lie in one folder, parted by ``rejected``.
    """
    kinds = _types(measures, to)
    losses = _losses(kinds, thousands)
    if date:
        text = F.col(date).isNotNull()
        losses[date] = {"n_text": text, "n_null_after": text & F.col(date).try_cast("date").isNull(), "n_digits_lost": F.lit(False)}
    bad = {m: of["n_null_after"] | of["n_digits_lost"] for m, of in losses.items()}
    reasons = F.filter(F.array(*[F.when(b, F.lit(m)) for m, b in bad.items()]), lambda r: r.isNotNull())
    flagged = raw.withColumns({"_raw": F.struct(*raw.columns), "reasons": reasons})
    seen = Observation()
    counts = [F.count_if(c).alias(f"{m}.{n}") for m, of in losses.items() for n, c in of.items()]
    observed = flagged.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("reasons") > 0).alias("n_rejected"), *counts)
    cleaned = clean_sales(observed, measures, date, to, thousands)
    is_bad = F.size("reasons") > 0
    kept = [F.when(~is_bad, F.col(c)).alias(c) for c in raw.columns]
    cleaned.select(
        F.struct(*kept).alias("row"), F.when(is_bad, F.struct("_raw.*", "reasons")).alias("refused"), is_bad.alias("rejected")
    ).write.partitionBy("rejected").parquet(path)
    spark, whole = raw.sparkSession, seen.get
    parts = spark.read.parquet(path) if whole["n_rows"] else None
    if parts is None:  # nothing was written, not even a schema
        accepted, rejected = clean_sales(raw, measures, date, to, thousands).limit(0), raw.withColumn("reasons", reasons).limit(0)
    else:
        accepted, rejected = parts.where("rejected = 'false'").select("row.*"), parts.where("rejected = 'true'").select("refused.*")
    names = ("n_text", "n_null_after", "n_digits_lost")
    facts = [(m, *[whole[f"{m}.{n}"] for n in names], whole["n_rows"], whole["n_rejected"]) for m in losses]
    longs = ", ".join(f"{n} long" for n in (*names, "n_rows", "n_rejected"))
    return accepted, rejected, spark.createDataFrame(facts, f"column string, {longs}")  # a row a column


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a NULL (or NaN) in any of the columns."""
    return df.na.drop(how="any", subset=list(columns) if columns else None)


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: all rows, complete rows, and the NULL (or NaN) count of each column, from one pass."""
    columns = list(columns or df.columns)
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}

    def missing(name):
        gap = F.col(name).isNull()
        return gap | F.isnan(name) if name in floating else gap

    any_missing = F.lit(False)
    for name in columns:
        any_missing = any_missing | missing(name)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~any_missing).alias("n_complete"),
        *[F.count_if(missing(name)).alias(f"null_{name}") for name in columns],
    )
