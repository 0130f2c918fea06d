"""Corpus-scale text operators: sharding, similarity joins, tokenising, deduplication, filtering and extraction.

Every operator is a function DataFrame -> DataFrame.  Nothing outside this package imports it.
Functions that run in Python workers are shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
