"""Spark-native analytics over genetic association summary statistics."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their jobs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
