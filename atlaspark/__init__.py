"""Spark-native corpus cartography: documents to a queryable map."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run on executors travel by value: the executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
