"""Table governance on Spark: profile, validate, find personal data, mask, score and compare tables."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
