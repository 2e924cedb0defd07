"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
