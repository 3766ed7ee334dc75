"""Operators for training-data pipelines.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task functions of this subpackage travel by value, so executors need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
