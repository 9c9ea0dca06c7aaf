"""Operators of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
