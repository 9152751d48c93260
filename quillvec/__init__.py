"""Spark-native embedding corpora and vector search.

Every operator takes and returns DataFrames; see README.md for the map.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel by value, so executors need NumPy and Arrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
