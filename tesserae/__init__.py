"""Constraint mining and constrained attribution on Spark."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run on executors travel by value, so a worker needs no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
