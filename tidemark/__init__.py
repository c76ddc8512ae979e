"""Retail demand analytics as Spark DataFrame operators.

Layout:

* ``sources``    tables in, forecasts out
* ``functions``  column expressions (dates, decimal-comma numbers)
* ``operators``  DataFrame -> DataFrame steps (cleaning, panel, series, split, features)
* ``plans``      whole analyses built from the operators (baseline, forecast, regressors, folds)
* ``registry``   the named queries and the SQL each is checked against
"""
