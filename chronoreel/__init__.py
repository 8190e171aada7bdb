"""Spark-native analytics over long videos: index, retrieve, answer, evaluate, sample."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
