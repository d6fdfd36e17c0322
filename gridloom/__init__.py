"""Distributed array analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
