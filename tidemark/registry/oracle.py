"""DuckDB SQL for the named queries, stated in the most direct form rather than in the form the Spark plans take."""

from __future__ import annotations

SPARSE = """
sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS store_id, l_partkey AS product_id,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty,
         CAST(l_extendedprice AS DECIMAL(18,4)) AS revenue,
         CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS tax,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS cost
  FROM lineitem)"""

DENSE = """
sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store_id, p_brand AS product_id,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""

SPARSE_STORES = """
stores AS (
  SELECT s_suppkey AS store_id, s_name AS store_code, r_name AS region, n_name AS district,
         concat('C', s_suppkey % 20) AS city, substr(r_name, 1, 2) AS state,
         CAST(1990 + s_suppkey % 10 AS INTEGER) AS opened_year
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""

DENSE_STORES = """
stores AS (
  SELECT n_nationkey AS store_id, n_name AS store_code, r_name AS region,
         concat(r_name, '-', n_nationkey % 2) AS district, concat('C', n_nationkey % 20) AS city,
         substr(r_name, 1, 2) AS state, CAST(1990 + n_nationkey % 10 AS INTEGER) AS opened_year
  FROM nation JOIN region ON r_regionkey = n_regionkey)"""

SPARSE_PRODUCTS = """
products AS (
  SELECT p_partkey AS product_id, p_brand AS supplier, p_name AS product_name, p_type AS category,
         concat(p_type, '-', p_size % 5) AS sub_category
  FROM part)"""

DENSE_PRODUCTS = "products AS (SELECT DISTINCT p_brand AS product_id FROM part)"

PANEL = """
panel AS (
  SELECT date, store_id, product_id, sum(qty) AS qty FROM sales GROUP BY date, store_id, product_id)"""

RANKED = """
ranked AS (
  SELECT *, percent_rank() OVER (ORDER BY date) <= 0.8 AS is_train FROM panel)"""

DATE_PARTS = """
CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
CAST(day(date) AS INTEGER) AS day_of_month, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _r(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name or expr}"


def _rs(*names: str) -> str:
    return ", ".join(_r(n) for n in names)


ORACLE: dict[str, str] = {}

# -- sources, cleaning -----------------------------------------------------------------------------------------

ORACLE["sales_rows"] = _with(SPARSE) + (
    f"SELECT date, store_id, product_id, {_rs('qty', 'revenue', 'tax', 'cost')} FROM sales"
)
ORACLE["store_rows"] = _with(SPARSE_STORES) + "SELECT * FROM stores"
ORACLE["product_rows"] = _with(SPARSE_PRODUCTS) + "SELECT * FROM products"
ORACLE["plain_dimension"] = "SELECT n_nationkey AS unit_id, n_name AS unit_name FROM nation"
ORACLE["calendar_days"] = _with(SPARSE) + (
    "SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sales"
)
ORACLE["clean_decimal_comma"] = f"""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date, l_suppkey AS store_id, l_partkey AS product_id,
       {_r('CAST(l_quantity AS DECIMAL(12,2))', 'qty')},
       {_r('CAST(l_extendedprice AS DECIMAL(18,4))', 'revenue')},
       {_r('CAST(l_extendedprice * l_tax AS DECIMAL(18,4))', 'tax')},
       {_r('CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))', 'cost')}
FROM lineitem"""
_TEXTS = {
    "qty": "CAST(l_quantity AS DECIMAL(12,2))",
    "revenue": "CAST(l_extendedprice AS DECIMAL(18,4))",
    "tax": "CAST(l_extendedprice * l_tax AS DECIMAL(18,4))",
    "cost": "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))",
}
ORACLE["clean_default_types"] = ORACLE["clean_decimal_comma"]
ORACLE["parse_audit"] = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({e}) AS n_text,
       count({e}) - count(TRY_CAST({e} AS DECIMAL(12,2))) AS n_null_after,
       count(*) FILTER (WHERE TRY_CAST({e} AS DECIMAL(12,2)) <> {e}) AS n_digits_lost FROM lineitem"""
    for c, e in _TEXTS.items()
)
ORACLE["audited_write"] = ORACLE["parse_audit"]
ORACLE["accepted_rows"] = "SELECT l_orderkey, l_linenumber, " + " AND ".join(
    f"coalesce(CAST({e} AS DECIMAL(12,2)) = {e}, true)" for e in _TEXTS.values()
) + " AS accepted FROM lineitem"
ORACLE["null_audit"] = _with(SPARSE) + (
    """SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE date IS NOT NULL AND store_id IS NOT NULL AND product_id IS NOT NULL AND qty IS NOT NULL
                        AND revenue IS NOT NULL AND tax IS NOT NULL AND cost IS NOT NULL) AS n_complete,
"""
    + ", ".join(
        f"count(*) - count({c}) AS null_{c}" for c in ("date", "store_id", "product_id", "qty", "revenue", "tax", "cost")
    )
    + " FROM sales"
)
ORACLE["complete_rows"] = """
SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id
WHERE lang IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL"""
ORACLE["row_counts"] = _with(DENSE, PANEL) + (
    "SELECT (SELECT count(*) FROM sales) AS n_sales, (SELECT count(*) FROM panel) AS n_panel"
)

# -- dates -----------------------------------------------------------------------------------------------------

ORACLE["date_features"] = _with(SPARSE) + f"SELECT DISTINCT date, {DATE_PARTS} FROM sales"
ORACLE["month_keys"] = _with(SPARSE) + """
SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, last_day(date) AS month_end,
       strftime(date, '%Y-%m') AS label, concat(year(date), '-', month(date)) AS short_label, count(*) AS n
FROM sales GROUP BY ALL"""

# -- totals, joins ---------------------------------------------------------------------------------------------

MONTH = "CAST(date_trunc('month', date) AS DATE)"

ORACLE["monthly_sales"] = _with(SPARSE) + f"""
SELECT {MONTH} AS month_start, last_day({MONTH}) AS month_end, {_r('sum(qty)', 'qty')},
       {_r('sum(revenue)', 'revenue')}
FROM sales GROUP BY {MONTH}"""
ORACLE["monthly_sales_by_store"] = _with(
    DENSE,
    DENSE_STORES,
    f"m AS (SELECT {MONTH} AS month_start, store_id, sum(qty) AS qty FROM sales GROUP BY {MONTH}, store_id)",
) + (
    f"SELECT s.*, month_start, last_day(month_start) AS month_end, {_r('qty')} FROM m JOIN stores s "
    "ON s.store_id = m.store_id"
)
ORACLE["daily_sales"] = _with(SPARSE) + f"SELECT date, {_r('sum(qty)', 'qty')} FROM sales GROUP BY date"
ORACLE["daily_panel"] = _with(DENSE, PANEL) + f"SELECT date, store_id, product_id, {_r('qty')} FROM panel"
ORACLE["enriched_panel"] = _with(SPARSE, PANEL, SPARSE_STORES, SPARSE_PRODUCTS) + f"""
SELECT date, p.store_id, p.product_id, {_r('qty')}, {DATE_PARTS}, store_code, region, district, city, state,
       opened_year, CAST(2002 - opened_year AS INTEGER) AS years_open, supplier, product_name, category, sub_category
FROM panel p JOIN stores s ON s.store_id = p.store_id JOIN products q ON q.product_id = p.product_id"""
ORACLE["store_age"] = _with(SPARSE_STORES) + (
    "SELECT store_id, CAST(2002 - opened_year AS INTEGER) AS years_open FROM stores"
)
ORACLE["distinct_keys"] = _with(SPARSE_STORES, SPARSE_PRODUCTS) + (
    "SELECT 'store' AS dimension, store_id AS id FROM stores UNION SELECT 'product', product_id FROM products"
)
ORACLE["distinct_dimensions"] = _with(DENSE) + "SELECT DISTINCT store_id, product_id FROM sales"

# -- series ----------------------------------------------------------------------------------------------------


def _months(keys: str = "") -> str:
    extra = f", {keys}" if keys else ""
    return f"""
months AS (
  SELECT month_start{extra}, CAST(qty AS DOUBLE) AS qty FROM (
    SELECT {MONTH} AS month_start{extra}, sum(qty) AS qty FROM sales GROUP BY {MONTH}{extra}))"""


def _decomposition(keys: str, additive: bool) -> str:
    """Period 12. Every step is a grouped table joined back."""
    extra = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    away, inverse = ("-", "+") if additive else ("/", "*")
    same = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    low = "" if additive else "AND min(qty) > 0"
    return f"""
fit_series AS (
  SELECT {extra}count(*) AS n FROM months {group}
  HAVING count(*) >= 24
     AND count(*) = max(year(month_start) * 12 + month(month_start)) - min(year(month_start) * 12 + month(month_start)) + 1
     AND count(qty) = count(*) {low}),
numbered AS (
  SELECT m.*, n, row_number() OVER ({part} ORDER BY month_start) - 1 AS i FROM months m JOIN fit_series {same}),
trended AS (
  SELECT {extra}month_start, qty, i,
         CASE WHEN i >= 6 AND i < n - 6 THEN
           (sum(qty) OVER ({part} ORDER BY i ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
          + sum(qty) OVER ({part} ORDER BY i ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24 END AS trend
  FROM numbered),
phases AS (SELECT {extra}i % 12 AS k, avg(qty {away} trend) AS s FROM trended GROUP BY {extra}i % 12),
centres AS (SELECT {extra}avg(s) AS c FROM phases {group}),
seasons AS (SELECT {extra}k, s {away} c AS seasonal FROM phases JOIN centres {same})
SELECT {extra}month_start, {_r('qty')}, {_r('trend')}, {_r('seasonal')},
       {_r(f'qty {away} (trend {inverse} seasonal)', 'resid')}
FROM trended JOIN seasons {f'USING ({keys})' if keys else 'ON true'}
WHERE k = i % 12"""


ORACLE["decompose_monthly"] = _with(SPARSE, _months()) + "," + _decomposition("", False)
ORACLE["decompose_additive"] = _with(SPARSE, _months()) + "," + _decomposition("", True)
ORACLE["decompose_by_store"] = _with(DENSE, _months("store_id")) + "," + _decomposition("store_id", False)
ORACLE["decompose_by_store_issues"] = _with(DENSE, _months("store_id")) + """
SELECT issue, count(*) AS n_series FROM (
  SELECT CASE
           WHEN count(*) < 24 THEN 'fewer than 24 rows'
           WHEN count(*) <> date_diff('month', min(month_start), max(month_start)) + 1 THEN 'periods missing or repeated'
           WHEN count(qty) < count(*) THEN 'NULL values'
           WHEN min(qty) <= 0 THEN 'zero or negative values in a multiplicative model' END AS issue
  FROM months GROUP BY store_id)
GROUP BY issue"""
ORACLE["decompose_refused"] = _with(SPARSE, _months("store_id, product_id")) + """
SELECT issue, count(*) AS n_series FROM (
  SELECT CASE
           WHEN count(*) < 24 THEN 'fewer than 24 rows'
           WHEN count(*) <> date_diff('month', min(month_start), max(month_start)) + 1 THEN 'periods missing or repeated'
           WHEN count(qty) < count(*) THEN 'NULL values'
           WHEN min(qty) <= 0 THEN 'zero or negative values in a multiplicative model' END AS issue
  FROM months GROUP BY store_id, product_id)
WHERE issue IS NOT NULL GROUP BY issue"""


def _autocorrelation(keys: str, max_lag: int) -> str:
    extra = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    same = f"a.{keys} = b.{keys} AND" if keys else ""
    a_key = f"a.{keys}, " if keys else ""
    by = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
sold AS (SELECT {extra}date, CAST(sum(qty) AS DOUBLE) AS y FROM sales GROUP BY {extra}date),
calendar AS (
  SELECT {extra}CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sold {group}),
days AS (SELECT {extra}date, coalesce(y, 0) AS y FROM calendar LEFT JOIN sold USING ({extra}date)),
z AS (
  SELECT {extra}row_number() OVER ({part} ORDER BY date) AS i, y - avg(y) OVER ({part}) AS z FROM days),
scale AS (SELECT {extra}count(*) AS n, sum(z * z) AS c0 FROM z {group}),
lagged AS (
  SELECT {a_key}b.i - a.i AS lag, sum(a.z * b.z) AS c
  FROM z a JOIN z b ON {same} b.i > a.i AND b.i <= a.i + {max_lag}
  GROUP BY {a_key}b.i - a.i)
SELECT {extra}n, CAST(lag AS INTEGER) AS lag, {_r('c / c0', 'r')}, {_r('1.959963984540054 / sqrt(n)', 'band_95')},
       {_r('2.5758293035489004 / sqrt(n)', 'band_99')}
FROM lagged JOIN scale {by}"""


ORACLE["autocorrelation_daily"] = _with(SPARSE) + "," + _autocorrelation("", 550)
ORACLE["autocorrelation_by_store"] = _with(DENSE) + "," + _autocorrelation("store_id", 60)

# -- correlation -----------------------------------------------------------------------------------------------

_MEASURES = ("qty", "revenue", "tax", "cost")
CORRELATIONS = "corrs AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr FROM sales"
    for a in _MEASURES
    for b in _MEASURES
) + ")"
ORACLE["correlation_matrix"] = _with(SPARSE, CORRELATIONS) + f"SELECT col_a, col_b, {_r('corr')} FROM corrs"
ORACLE["collinear_pairs"] = _with(SPARSE, CORRELATIONS) + (
    f"SELECT col_a, col_b, {_r('corr')} FROM corrs WHERE col_a < col_b AND abs(corr) >= 0.5"
)

_WIDE = {c: c for c in _MEASURES} | {
    "year": "year(date)",
    "month": "month(date)",
    "day_of_month": "day(date)",
    "day_of_week": "dayofweek(date) + 1",
    "day_of_year": "dayofyear(date)",
    "week_of_year": "weekofyear(date)",
}
ORACLE["correlation_wide"] = _with(
    SPARSE, "wide AS (SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _WIDE.items()) + " FROM sales)"
) + "\nUNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    f"{_r(f'corr({a}, {b})', 'corr')} FROM wide"
    for a in _WIDE
    for b in _WIDE
)
# the third column against one or two others, by the formula for the multiple correlation of three columns
ORACLE["variance_inflation"] = _with(
    SPARSE,
    """r AS (
  SELECT corr(CAST(qty AS DOUBLE), CAST(revenue AS DOUBLE)) AS a, corr(CAST(qty AS DOUBLE), CAST(cost AS DOUBLE)) AS b,
         corr(CAST(revenue AS DOUBLE), CAST(cost AS DOUBLE)) AS c FROM sales)""",
    "second AS (SELECT *, 1 / (1 - a * a) AS v2 FROM r)",
    """third AS (
  SELECT *, CASE WHEN v2 <= 5 THEN 1 / (1 - (b * b + c * c - 2 * a * b * c) / (1 - a * a)) ELSE 1 / (1 - b * b) END AS v3
  FROM second)""",
) + f"""
SELECT 'qty' AS "column", 0 AS position, 1.0::DOUBLE AS inflation, true AS kept
UNION ALL SELECT 'revenue', 1, {_r('v2', 'x')}, v2 <= 5 FROM third
UNION ALL SELECT 'cost', 2, {_r('v3', 'x')}, v3 <= 5 FROM third"""

# -- features --------------------------------------------------------------------------------------------------

_STORE_CATS = ("store_code", "region", "district", "city", "state")
_PRODUCT_CATS = ("supplier", "product_name", "category", "sub_category")


def _index(table: str, columns: tuple[str, ...]) -> str:
    return "idx AS (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n, "
        f"row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS idx FROM {table} GROUP BY {c}"
        for c in columns
    ) + ")"


def _slots(table: str, key: str, columns: tuple[str, ...]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {key}, '{c}' AS feature, "
        f"CASE WHEN idx < (SELECT max(idx) FROM idx WHERE feature = '{c}') THEN idx END AS slot "
        f"FROM {table} JOIN idx ON feature = '{c}' AND value = {c} "
        f"WHERE (SELECT max(idx) FROM idx WHERE feature = '{c}') > 0"
        for c in columns
    )


ORACLE["category_index_store"] = _with(SPARSE_STORES, _index("stores", _STORE_CATS)) + "SELECT * FROM idx"
ORACLE["category_index_product"] = _with(SPARSE_PRODUCTS, _index("products", _PRODUCT_CATS)) + "SELECT * FROM idx"
ORACLE["onehot_store"] = _with(SPARSE_STORES, _index("stores", _STORE_CATS)) + _slots(
    "stores", "store_id", _STORE_CATS
)
ORACLE["onehot_product"] = _with(SPARSE_PRODUCTS, _index("products", _PRODUCT_CATS)) + _slots(
    "products", "product_id", _PRODUCT_CATS
)
SPARSE_RANKED = (SPARSE, PANEL, RANKED, SPARSE_STORES, SPARSE_PRODUCTS)
_KNOWN = "known AS (SELECT * FROM products WHERE product_id IN (SELECT product_id FROM ranked WHERE is_train))"
ORACLE["encoder_slots"] = _with(SPARSE, PANEL, RANKED, SPARSE_PRODUCTS, _KNOWN, _index("known", _PRODUCT_CATS)) + (
    "\nUNION ALL ".join(
        f"SELECT product_id, '{c}' AS feature, CAST(coalesce(idx, (SELECT count(*) FROM idx WHERE feature = '{c}')) AS BIGINT) AS slot "
        f"FROM products LEFT JOIN idx ON feature = '{c}' AND value = {c}"
        for c in _PRODUCT_CATS
    )
)
_TRAIN = """train AS (
  SELECT date, qty, store_code, region, district, city, state, supplier, product_name, category, sub_category
  FROM ranked JOIN stores USING (store_id) JOIN products USING (product_id) WHERE is_train)"""
_MEANS = "means AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n, CAST(sum(qty) AS DOUBLE) / count(*) AS mean FROM train GROUP BY {c}"
    for c in (*_STORE_CATS, *_PRODUCT_CATS)
) + ")"
ORACLE["category_bins"] = _with(*SPARSE_RANKED, _TRAIN, _MEANS) + f"""
SELECT feature, value, n, {_r('mean')},
       CAST(least(15, floor((sum(n) OVER (PARTITION BY feature ORDER BY mean, value) - n) * 16 / sum(n) OVER (PARTITION BY feature))) AS INTEGER) AS bin
FROM means"""
_CELLS = ", ".join(f"['{c}=' || {c}, '1']" for c in (*_STORE_CATS, *_PRODUCT_CATS))
ORACLE["linear_sums"] = _with(
    *SPARSE_RANKED,
    _TRAIN,
    f"""cells AS (
  SELECT row_number() OVER () AS r, unnest([['1', '1'], ['month', month(date)::VARCHAR], ['day_of_week', (dayofweek(date) + 1)::VARCHAR],
         ['qty', qty::VARCHAR], {_CELLS}]) AS cell FROM train)""",
    "plain AS (SELECT r, cell[1] AS name, CAST(cell[2] AS DOUBLE) AS x FROM cells)",
) + f"""
SELECT a.name AS a, b.name AS b, {_r('sum(a.x * b.x)', 'total')}
FROM plain a JOIN plain b ON a.r = b.r AND a.name <= b.name GROUP BY a.name, b.name"""
_SCALED = {"year": "year(date)", "month": "month(date)", "day_of_week": "dayofweek(date) + 1"}
ORACLE["scaled_features"] = _with(
    DENSE,
    PANEL,
    RANKED,
    "std AS (SELECT "
    + ", ".join(f"stddev_samp(CAST({e} AS DOUBLE)) AS sd_{n}" for n, e in _SCALED.items())
    + " FROM ranked WHERE is_train)",
) + (
    "SELECT date, store_id, product_id, "
    + ", ".join(_r(f"CASE WHEN sd_{n} > 0 THEN ({e}) / sd_{n} ELSE 0 END", f"{n}_scaled") for n, e in _SCALED.items())
    + " FROM ranked, std"
)

# -- split and baseline ----------------------------------------------------------------------------------------

ORACLE["split_cutoff"] = _with(DENSE, PANEL, RANKED) + (
    "SELECT max(date) FILTER (WHERE is_train) AS cutoff, count(*) AS n_rows FROM ranked"
)
ORACLE["chrono_split"] = _with(DENSE, PANEL, RANKED) + (
    f"SELECT date, store_id, product_id, {_r('qty')}, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split FROM ranked"
)

FIT = """
fit AS (
  SELECT year(date) AS year, month(date) AS month, store_id, product_id, avg(CAST(qty AS DOUBLE)) AS prediction
  FROM {rows} GROUP BY ALL)"""
ORACLE["baseline_fit"] = _with(DENSE, PANEL, FIT.format(rows="panel")) + (
    "SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, store_id, product_id, "
    f"{_r('prediction')} FROM fit"
)
ORACLE["baseline_fit_one_shuffle"] = _with(DENSE, PANEL, FIT.format(rows="panel")) + (
    f"SELECT make_date(year, month, 1) AS month_start, store_id, product_id, {_r('prediction')} FROM fit"
)

ORACLE["panel_refreshed"] = ORACLE["daily_panel"]
ORACLE["fit_refreshed"] = ORACLE["baseline_fit"]
TRAIN_FIT = FIT.format(rows="ranked WHERE is_train")
SCORED = """
scored AS (
  SELECT r.*, f.prediction, f.store_id IS NOT NULL AS matched FROM ranked r LEFT JOIN fit f
  ON f.year = year(r.date{back}) AND f.month = month(r.date{back})
     AND f.store_id = r.store_id AND f.product_id = r.product_id)"""
SAME_MONTH = SCORED.format(back="")
YEAR_BEFORE = SCORED.format(back=" - INTERVAL 12 MONTH")

for _part, _condition in (("train", "is_train"), ("test", "NOT is_train")):
    ORACLE[f"baseline_{_part}_predictions"] = _with(DENSE, PANEL, RANKED, TRAIN_FIT, SAME_MONTH) + (
        f"SELECT date, store_id, product_id, {_rs('qty', 'prediction')} FROM scored WHERE matched AND {_condition}"
    )

ERRORS = f"""
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, count(prediction) AS n_scored,
       {_r('sqrt(avg((CAST(qty AS DOUBLE) - prediction) ** 2))', 'rmse')},
       {_r('count(prediction) / count(*)', 'coverage')}
FROM scored GROUP BY is_train"""
ORACLE["baseline_rmse"] = _with(DENSE, PANEL, RANKED, TRAIN_FIT, SAME_MONTH) + ERRORS
ORACLE["baseline_rmse_seasonal"] = _with(DENSE, PANEL, RANKED, TRAIN_FIT, YEAR_BEFORE) + ERRORS

ORACLE["lr_single_feature"] = _with(
    SPARSE,
    """days AS (
  SELECT date, CAST(date_diff('day', (SELECT min(date) FROM sales), date) AS DOUBLE) AS day_no,
         CAST(sum(qty) AS DOUBLE) AS qty
  FROM sales GROUP BY date)""",
    "line AS (SELECT regr_slope(qty, day_no) AS a, regr_intercept(qty, day_no) AS b FROM days)",
) + f"SELECT date, {_r('qty')}, {_r('a * day_no + b', 'prediction')} FROM days, line"

ORACLE["bucketed_predictions"] = ORACLE["baseline_test_predictions"]
_NUMBERS = {
    "year": "year(date)",
    "month": "month(date)",
    "day_of_month": "day(date)",
    "day_of_week": "dayofweek(date) + 1",
    "day_of_year": "dayofyear(date)",
    "week_of_year": "weekofyear(date)",
    "years_open": "2002 - opened_year",
}
ORACLE["assembled_vector_sums"] = _with(
    *SPARSE_RANKED,
    _TRAIN.replace("SELECT date", "SELECT opened_year, date"),
    _index("stores", _STORE_CATS).replace("idx AS", "store_idx AS"),
    _index("products", _PRODUCT_CATS).replace("idx AS", "product_idx AS"),
    "idx AS (SELECT * FROM store_idx UNION ALL SELECT * FROM product_idx)",
    "held AS (SELECT feature, value FROM idx QUALIFY idx < max(idx) OVER (PARTITION BY feature))",
    "met AS (" + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM train" for c in (*_STORE_CATS, *_PRODUCT_CATS)) + ")",
) + "\nUNION ALL ".join(
    f"SELECT '{n}' AS name, {_r(f'sum({e})', 'total')} FROM train" for n, e in _NUMBERS.items()
) + f"""
UNION ALL SELECT feature || '=' || value, {_r('count(m.value)', 'total')} FROM held h LEFT JOIN met m USING (feature, value) GROUP BY feature, h.value, value"""
ORACLE["one_split_comparison"] = _with(
    SPARSE,
    PANEL,
    RANKED,
    TRAIN_FIT,
    SAME_MONTH,
    "months AS (SELECT month(date) AS m, count(*) AS n, sum(CAST(qty AS DOUBLE)) AS s FROM ranked WHERE is_train GROUP BY month(date))",
    """cuts AS (
  SELECT c.m AS cut, sum(s) FILTER (WHERE a.m <= c.m) / sum(n) FILTER (WHERE a.m <= c.m) AS low,
         sum(s) FILTER (WHERE a.m > c.m) / sum(n) FILTER (WHERE a.m > c.m) AS high,
         sum(s) FILTER (WHERE a.m <= c.m) ** 2 / sum(n) FILTER (WHERE a.m <= c.m)
           + sum(s) FILTER (WHERE a.m > c.m) ** 2 / sum(n) FILTER (WHERE a.m > c.m) AS gain
  FROM months a, (SELECT m FROM months) c WHERE c.m < (SELECT max(m) FROM months) GROUP BY c.m)""",
    "best AS (SELECT * FROM cuts ORDER BY gain DESC LIMIT 1)",
) + f"""
SELECT 'baseline' AS model, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, count(prediction) AS n_scored,
       {_r('sqrt(avg((CAST(qty AS DOUBLE) - prediction) ** 2))', 'rmse')} FROM scored GROUP BY is_train
UNION ALL
SELECT 'one_split', CASE WHEN is_train THEN 'train' ELSE 'test' END, count(*), count(*),
       {_r('sqrt(avg((CAST(qty AS DOUBLE) - CASE WHEN month(date) <= cut THEN low ELSE high END) ** 2))', 'rmse')}
FROM ranked, best GROUP BY is_train"""

# -- forecast --------------------------------------------------------------------------------------------------

FUTURE = """
future AS (
  SELECT CAST(last + CAST(i AS INTEGER) AS DATE) AS date, CAST(i AS INTEGER) AS day_no
  FROM (SELECT max(date) AS last FROM sales), range(1, 91) t(i))"""
CELLS = """
cells AS (
  SELECT g.date, day_no, g.store_id, g.product_id, coalesce(prediction, 0) AS prediction
  FROM (SELECT date, day_no, store_id, product_id FROM future, (SELECT DISTINCT store_id FROM stores),
               (SELECT DISTINCT product_id FROM products)) g
  LEFT JOIN fit f ON f.year = year(g.date - INTERVAL 12 MONTH) AND f.month = month(g.date - INTERVAL 12 MONTH)
       AND f.store_id = g.store_id AND f.product_id = g.product_id)"""
ZERO_FIT = """
ends AS (SELECT (SELECT min(date) FROM panel) AS first, (SELECT max(date) FROM {rows}) AS last),
fit AS (
  SELECT year(date) AS year, month(date) AS month, store_id, product_id,
         CAST(sum(qty) AS DOUBLE) / (least(last_day(min(date)), any_value(last))
           - greatest(CAST(date_trunc('month', min(date)) AS DATE), any_value(first)) + 1) AS prediction
  FROM {rows}, ends GROUP BY ALL)"""


def _forecast(fit: str = FIT.format(rows="panel"), ranked: bool = False) -> str:
    middle = (PANEL, RANKED) if ranked else (PANEL,)
    return _with(DENSE, *middle, DENSE_STORES, DENSE_PRODUCTS, FUTURE, fit, CELLS)


ORACLE["hashed_feature_sums"] = _with(SPARSE_PRODUCTS) + (
    "SELECT supplier, sub_category, 2.0::DOUBLE AS total, 1::BIGINT AS n_vectors, 1::BIGINT AS n_alike_supplier, "
    "1::BIGINT AS n_alike_sub_category FROM products GROUP BY ALL"
)
FILLED_DAYS = """
sold AS (SELECT store_id, date, CAST(sum(qty) AS DOUBLE) AS y FROM sales GROUP BY ALL),
days AS (
  SELECT store_id, date, coalesce(y, 0) AS y FROM (
    SELECT store_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
    FROM sold GROUP BY store_id) LEFT JOIN sold USING (store_id, date))"""
ORACLE["autoregression_of_order_one"] = (
    "WITH RECURSIVE " + ",\n".join([DENSE, FILLED_DAYS]) + f""",
lagged AS (SELECT y, lag(y) OVER (PARTITION BY store_id ORDER BY date) AS p FROM days),
line AS (SELECT regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM lagged),
ends AS (SELECT store_id, max(date) AS d, max_by(y, date) AS y FROM days GROUP BY store_id),
steps AS (
  SELECT store_id, 1 AS step, d + 1 AS date, a + b * y AS prediction FROM ends, line
  UNION ALL SELECT store_id, step + 1, date + 1, a + b * prediction FROM steps, line WHERE step < 30)
SELECT store_id, CAST(step AS INTEGER) AS step, CAST(date AS DATE) AS date, {_r('prediction')} FROM steps"""
)
ORACLE["autoregression_by_store"] = (
    "WITH RECURSIVE " + ",\n".join([DENSE, FILLED_DAYS]) + f""",
lagged AS (SELECT store_id, y, lag(y) OVER (PARTITION BY store_id ORDER BY date) AS p FROM days),
line AS (SELECT store_id, regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM lagged GROUP BY store_id),
ends AS (SELECT store_id, max(date) AS d, max_by(y, date) AS y FROM days GROUP BY store_id),
steps AS (
  SELECT store_id, 1 AS step, d + 1 AS date, a + b * y AS prediction FROM ends JOIN line USING (store_id)
  UNION ALL SELECT store_id, step + 1, date + 1, a + b * prediction FROM steps JOIN line USING (store_id) WHERE step < 30)
SELECT store_id, CAST(step AS INTEGER) AS step, CAST(date AS DATE) AS date, {_r('prediction')} FROM steps"""
)
ORIGINS = """
flagged AS (SELECT *, percent_rank() OVER (ORDER BY date) <= 0.8 AS is_train FROM days),
ends AS (SELECT max(date) FILTER (WHERE is_train) AS cutoff, (SELECT max(date) FROM sales) AS last FROM flagged),
cases AS (
  SELECT horizon, store_id, date, y, is_train, cutoff, last, coalesce((
      SELECT sum(b.y) FROM days b WHERE b.store_id = f.store_id AND b.date > f.date AND b.date <= f.date + horizon), 0) AS ahead
  FROM flagged f, ends, (SELECT unnest([30, 60, 90]) AS horizon)),
lines AS (
  SELECT horizon, regr_slope(ahead, y) AS b, regr_intercept(ahead, y) AS a FROM cases
  WHERE date + horizon <= cutoff GROUP BY horizon)"""
ORACLE["horizon_one_input"] = _with(DENSE, FILLED_DAYS, ORIGINS) + f"""
SELECT horizon, split, count(*) AS n_rows, count(*) AS n_scored, {_r('sqrt(avg((ahead - a - b * y) ** 2))', 'rmse')}
FROM (SELECT *, CASE WHEN date + horizon <= cutoff THEN 'train'
                     WHEN NOT is_train AND date + horizon <= last THEN 'test' END AS split
      FROM cases JOIN lines USING (horizon))
WHERE split IS NOT NULL GROUP BY horizon, split"""
ORACLE["horizon_one_input_forecast"] = _with(DENSE, FILLED_DAYS, ORIGINS) + f"""
SELECT store_id, max(date) AS date, {', '.join(
    _r(f'any_value(CASE WHEN horizon = {h} AND date = d THEN a + b * y END)', f'demand_{h}') for h in (30, 60, 90))}
FROM (SELECT *, max(date) OVER (PARTITION BY store_id) AS d FROM cases JOIN lines USING (horizon)) GROUP BY store_id"""
ORACLE["future_calendar"] = _with(SPARSE, FUTURE) + """
SELECT date, day_no, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(date_trunc('month', date - INTERVAL 12 MONTH) AS DATE) AS donor_month
FROM future"""
ORACLE["forecast_grid_size"] = _with(SPARSE, SPARSE_STORES, SPARSE_PRODUCTS, FUTURE) + """
SELECT d AS n_days, s AS n_stores, p AS n_products, d * s * p AS n_cells
FROM (SELECT count(*) AS d FROM future), (SELECT count(DISTINCT store_id) AS s FROM stores),
     (SELECT count(DISTINCT product_id) AS p FROM products)"""
ORACLE["forecast_cells"] = _forecast() + f"SELECT date, store_id, product_id, {_r('prediction')} FROM cells"


def _daily(level: str) -> str:
    return f"SELECT date, {level}, {_r('sum(prediction)', 'prediction')} FROM cells GROUP BY date, {level}"


def _horizons(level: str) -> str:
    sums = ", ".join(
        _r(f"coalesce(sum(prediction) FILTER (WHERE day_no <= {h}), 0)", f"demand_{h}") for h in (30, 60, 90)
    )
    return f"SELECT {level}, {sums} FROM cells GROUP BY {level}"


ORACLE["forecast_daily_by_product"] = _forecast() + _daily("product_id")
ORACLE["forecast_daily_by_store"] = _forecast() + _daily("store_id")
ORACLE["forecast_daily_train_fit"] = _forecast(TRAIN_FIT, ranked=True) + _daily("product_id")
ORACLE["forecast_daily_zero_filled"] = _forecast(ZERO_FIT.format(rows="panel")) + _daily("product_id")
ORACLE["forecast_daily_train_zero_filled"] = (
    _forecast(ZERO_FIT.format(rows="(SELECT * FROM ranked WHERE is_train)"), ranked=True) + _daily("product_id")
)
ORACLE["forecast_horizons_by_product"] = _forecast() + _horizons("product_id")
ORACLE["forecast_horizons_by_store"] = _forecast() + _horizons("store_id")
ORACLE["forecast_csv_round_trip"] = ORACLE["forecast_daily_by_product"]

# -- extensions ------------------------------------------------------------------------------------------------

ORACLE["baseline_apply_fit"] = _with(DENSE, PANEL, RANKED, TRAIN_FIT) + f"""
SELECT p.date, p.store_id, p.product_id, {_r('p.qty', 'qty')}, {_r('prediction')}
FROM ranked p JOIN fit f ON f.store_id = p.store_id AND f.product_id = p.product_id
 AND f.year = year(p.date - INTERVAL 12 MONTH) AND f.month = month(p.date - INTERVAL 12 MONTH)
WHERE NOT is_train"""
ORACLE["lag_features"] = _with(DENSE, PANEL) + f"""
SELECT date, store_id, product_id, {_r('qty')}, {_r('lag(qty, 1) OVER w', 'qty_lag_1')},
       {_r('lag(qty, 7) OVER w', 'qty_lag_7')}
FROM panel WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date)"""
STORE_DAYS = "days AS (SELECT date, store_id, sum(qty) AS qty FROM sales GROUP BY date, store_id)"
ORACLE["calendar_lag_features"] = _with(DENSE, STORE_DAYS) + f"""
SELECT a.date, a.store_id, {_r('a.qty', 'qty')},
       {_r('(SELECT qty FROM days b WHERE b.store_id = a.store_id AND b.date = a.date - 7)', 'qty_lag_7')},
       {_r('(SELECT qty FROM days b WHERE b.store_id = a.store_id AND b.date = a.date - 365)', 'qty_lag_365')},
       {_r('(SELECT sum(qty) FROM days b WHERE b.store_id = a.store_id AND b.date > a.date - 28 AND b.date <= a.date) / 28.0', 'qty_mean_28')}
FROM days a"""
ORACLE["first_difference"] = _with(
    DENSE, f"m AS (SELECT {MONTH} AS month_start, store_id, sum(qty) AS qty FROM sales GROUP BY {MONTH}, store_id)"
) + f"""
SELECT month_start, last_day(month_start) AS month_end, store_id, {_r('qty')},
       {_r('qty - lag(qty) OVER (PARTITION BY store_id ORDER BY month_start)', 'qty_diff')}
FROM m"""
FOLDS = """
folds AS (
  SELECT CAST(k AS INTEGER) AS fold, last - CAST((4 - k) * 90 AS INTEGER) AS test_end,
         last - CAST((4 - k) * 90 + 89 AS INTEGER) AS test_start,
         last - CAST((4 - k) * 90 + 89 + 31 AS INTEGER) AS train_end
  FROM (SELECT max(date) AS last FROM sales), range(1, 5) t(k))"""
ORACLE["rolling_folds"] = _with(SPARSE, FOLDS) + "SELECT fold, train_end, test_start, test_end FROM folds"
ORACLE["rolling_scores"] = _with(
    DENSE,
    PANEL,
    FOLDS,
    """fit AS (
  SELECT fold, year(date) AS year, month(date) AS month, store_id, product_id, avg(CAST(qty AS DOUBLE)) AS prediction
  FROM panel JOIN folds ON date <= train_end GROUP BY ALL)""",
    """scored AS (
  SELECT o.fold, p.qty, f.prediction
  FROM panel p JOIN folds o ON p.date BETWEEN test_start AND test_end
  LEFT JOIN fit f ON f.fold = o.fold AND f.store_id = p.store_id AND f.product_id = p.product_id
       AND f.year = year(p.date - INTERVAL 12 MONTH) AND f.month = month(p.date - INTERVAL 12 MONTH))""",
) + f"""
SELECT fold, count(*) AS n_rows, count(prediction) AS n_scored,
       {_r('sqrt(avg((CAST(qty AS DOUBLE) - prediction) ** 2))', 'rmse')}
FROM scored GROUP BY fold"""
# two inputs, so that a fit is a system of two equations on the deviations, solved by determinants
ORACLE["rolling_linear_scores"] = _with(
    SPARSE,
    PANEL,
    FOLDS,
    "days AS (SELECT date, CAST(qty AS DOUBLE) AS y, CAST(month(date) AS DOUBLE) AS u, CAST(dayofweek(date) + 1 AS DOUBLE) AS v FROM panel)",
    """sums AS (
  SELECT fold, covar_pop(u, u) AS uu, covar_pop(v, v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy,
         avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM days JOIN folds ON date <= train_end GROUP BY fold)""",
    """lines AS (
  SELECT fold, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b, mu, mv, my FROM sums)""",
) + f"""
SELECT o.fold, count(*) AS n_rows, count(*) AS n_scored, {_r('sqrt(avg((y - my - a * (u - mu) - b * (v - mv)) ** 2))', 'rmse')}
FROM days JOIN folds o ON date BETWEEN test_start AND test_end JOIN lines USING (fold) GROUP BY o.fold"""
ORACLE["calendar_join"] = _with(
    DENSE,
    STORE_DAYS,
    """outside AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(o_totalprice) AS mean_order_value
  FROM orders GROUP BY ALL)""",
) + f"""
SELECT d.date, {MONTH.replace('date)', 'd.date)', 1)} AS month_start, store_id, {_rs('qty', 'mean_order_value')}
FROM days d LEFT JOIN outside o ON o.month_start = {MONTH.replace('date)', 'd.date)', 1)}"""
