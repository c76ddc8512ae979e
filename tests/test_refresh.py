import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning, panel
from tidemark.plans import baseline, refresh
from tidemark.registry import queries
from tidemark.runtime import session_options
from tidemark.sources import layout, standin
from tests.test_plans import executed, final


@pytest.fixture(scope="module")
def sales(spark, folder):
    return standin.sales(spark, folder)


def rows(df):
    return sorted(map(tuple, df.collect()))


def stored_equals(spark, folder, sales):
    whole = panel.daily_panel(sales)
    assert rows(refresh.panel(spark, folder)) == rows(whole.select("date", "store_id", "product_id", "qty"))
    fit = baseline.fit_panel(whole)
    assert rows(refresh.fit(spark, folder).select(*fit.columns)) == rows(fit)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_corrected_days_replace_and_other_months_stay(spark, sales, tmp_path):
    folder = str(tmp_path / "a")
    cut = F.lit("2000-03-17").cast("date")
    refresh.create(sales.where(F.col("date") < cut).withColumn("qty", F.when(F.col("date") == F.date_sub(cut, 5), 0).otherwise(F.col("qty")).cast("decimal(12,2)")), folder)
    before = files(folder)
    late = sales.where((F.col("date") >= F.date_sub(cut, 5)) & (F.col("date") < F.add_months(cut, 2)))
    months = refresh.refresh(late, folder)
    assert months == [dt.date(2000, m, 1) for m in (3, 4, 5)]
    stored_equals(spark, folder, sales.where(F.col("date") < F.add_months(cut, 2)))
    gone, new = before - files(folder), files(folder) - before
    touched = {p for p in gone | new}
    assert touched and all(any(f"month_start=2000-0{m}-01" in p for m in (3, 4, 5)) for p in touched)
    refresh.refresh(late, folder)  # once more changes nothing
    stored_equals(spark, folder, sales.where(F.col("date") < F.add_months(cut, 2)))


def test_late_rows_add(spark, sales, tmp_path):
    folder = str(tmp_path / "b")
    some = sales.withColumn("late", F.pmod(F.xxhash64("date", "store_id", "product_id", "qty"), F.lit(9)) == 0)
    refresh.create(some.where("NOT late").drop("late"), folder)
    assert refresh.refresh(some.where("late").drop("late"), folder, mode="add")
    stored_equals(spark, folder, sales)


def test_nothing_new_and_wrong_mode(spark, sales, tmp_path):
    folder = str(tmp_path / "c")
    refresh.create(sales.where("year(date) = 1996"), folder)
    before = files(folder)
    undated = sales.limit(3).withColumn("date", F.lit(None).cast("date"))
    assert refresh.refresh(sales.limit(0), folder) == [] and refresh.refresh(undated, folder) == [] and files(folder) == before
    with pytest.raises(ValueError):
        refresh.refresh(sales, folder, mode="merge")


def test_window_and_join_of_laid_out_tables_need_no_exchange(spark, folder, sales):
    rows_ = layout.bucketed(queries._dense_panel(spark, folder), buckets=4)
    flagged = rows_.withColumn("is_train", F.col("date") < F.lit("2000-01-01").cast("date"))
    with layout.as_laid_out(spark), session_options(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for key in ("year_month", "seasonal"):
            assert "Exchange" not in final(executed(baseline.predict(flagged, key)))
        fit = layout.bucketed(baseline.fit_panel(flagged.where("is_train")), buckets=4)
        joined = baseline.apply_fit(flagged, fit)
        assert "Exchange" not in final(executed(joined)) and "SortMergeJoin" in final(executed(joined))
    plain = queries._dense_panel(spark, folder).withColumn("is_train", F.col("date") < F.lit("2000-01-01").cast("date"))
    want = baseline.apply_fit(plain, baseline.fit_panel(plain.where("is_train")))
    assert rows(joined.where("prediction IS NOT NULL")) == rows(want.where("prediction IS NOT NULL").select(*joined.columns))
    for t in (rows_, fit):
        assert t.count() > 0


def test_bucket_counts_are_powers_of_two():
    assert [layout.bucket_count(n, 100) for n in (0, 800, 801, 5000)] == [8, 8, 16, 64]


RAW = [("1,5", "2020-01-02", 1), ("x", "2020-01-03", 2), (None, "bad", 3), ("2,125", None, 4), ("3", "2020-01-05", 5)]


def test_audit_and_rejects_of_one_pass(spark, tmp_path):
    raw = spark.createDataFrame(RAW, "qty string, date string, id int")
    kinds = {"qty": "decimal(12,2)"}
    accepted, rejected, audit = cleaning.write_cleaned(raw, str(tmp_path / "out"), ["qty"], to=kinds)
    assert sorted((r.id, float(r.qty), str(r.date)) for r in accepted.collect()) == [(1, 1.5, "2020-01-02"), (5, 3.0, "2020-01-05")]
    assert accepted.dtypes == cleaning.clean_sales(raw, ["qty"], to=kinds).dtypes
    assert sorted((r.id, r.qty, r.date, r.reasons) for r in rejected.collect()) == [
        (2, "x", "2020-01-03", ["qty"]),
        (3, None, "bad", ["date"]),
        (4, "2,125", None, ["qty"]),
    ]
    got = {r.column: tuple(r)[1:] for r in audit.collect()}
    assert got == {"qty": (4, 1, 1, 5, 3), "date": (4, 1, 0, 5, 3)}
    same = cleaning.parse_audit(raw, ["qty"], to=kinds).first()
    assert tuple(same)[1:] == got["qty"][:3]


def test_audit_of_no_rows(spark, tmp_path):
    raw = spark.createDataFrame([], "qty string, date string, id int")
    accepted, rejected, audit = cleaning.write_cleaned(raw, str(tmp_path / "none"), ["qty"])
    assert accepted.count() == rejected.count() == 0 and {r.n_rows for r in audit.collect()} == {0}
