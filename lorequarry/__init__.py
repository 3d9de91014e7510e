"""Spark-native knowledge-graph analytics over document corpora."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
