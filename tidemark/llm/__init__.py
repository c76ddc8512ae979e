"""Operators for preparing text corpora. Nothing else in the library imports this subpackage.

Functions that run in tasks are sent by value and broadcasts hold plain data (numbers, arrays, texts, tuples, dicts), so
executors need the libraries these use but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
