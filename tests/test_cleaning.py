import datetime as dt

import pytest
from pyspark.errors import PySparkException

from tidemark.functions.numbers import decimal_comma
from tidemark.operators import cleaning

RAW = [(1, "12,5"), (2, "1.234,56"), (3, ""), (4, None), (5, "abc")]


@pytest.fixture
def comma_numbers(spark):
    return spark.createDataFrame(RAW, "id int, raw string")


def parsed(df, **options):
    rows = df.select("id", decimal_comma("raw", **options).alias("v")).collect()
    return {r.id: None if r.v is None else float(r.v) for r in rows}


def test_lenient_numbers(comma_numbers):
    assert parsed(comma_numbers) == {1: 12.5, 2: None, 3: None, 4: None, 5: None}


def test_thousands_mark(comma_numbers):
    assert parsed(comma_numbers, thousands=".") == {1: 12.5, 2: 1234.56, 3: None, 4: None, 5: None}


def test_strict_fails(comma_numbers):
    with pytest.raises(PySparkException):
        parsed(comma_numbers, strict=True)


def test_float_type(comma_numbers):
    cleaned = cleaning.clean_sales(comma_numbers, ["raw"], date=None, to="float")
    assert dict(cleaned.dtypes)["raw"] == "float"
    assert cleaned.where("id = 1").first().raw == 12.5


def test_dates_and_audit(spark):
    raw = spark.createDataFrame(
        [("2020-01-02", "1,0", 1.0), ("no date", "2,0", float("nan")), ("2020-01-04", None, 2.0)],
        "date string, qty string, other double",
    )
    cleaned = cleaning.clean_sales(raw, ["qty"])
    assert cleaned.where("qty = 1").first().date == dt.date(2020, 1, 2)
    audit = cleaning.null_audit(cleaned).first()
    assert (audit.n_rows, audit.n_complete) == (3, 1)
    assert (audit.null_date, audit.null_qty, audit.null_other) == (1, 1, 1)
    assert cleaning.drop_incomplete(cleaned).count() == audit.n_complete


def test_default_type_keeps_digits_and_large_values(spark):
    raw = spark.createDataFrame([("0,125",), ("12345678901,5",), (None,), ("x",)], "qty string")
    got = [r.qty for r in cleaning.clean_sales(raw, ["qty"], date=None).collect()]
    assert got == [0.125, 12345678901.5, None, None]


def test_parse_audit_counts_what_is_lost(spark):
    rows = [("0,125", "1,5"), ("12345678901,5", "2"), ("1,25", None), ("x", "0,1"), (None, "0,2")]
    raw = spark.createDataFrame(rows, "qty string, cost string")
    small = {r.column: (r.n_text, r.n_null_after, r.n_digits_lost) for r in cleaning.parse_audit(raw, ["qty", "cost"], "decimal(12,2)").collect()}
    assert small == {"qty": (4, 2, 1), "cost": (4, 0, 0)}
    wide = {r.column: (r.n_null_after, r.n_digits_lost) for r in cleaning.parse_audit(raw, ["qty", "cost"]).collect()}
    assert wide == {"qty": (1, 0), "cost": (0, 0)}
