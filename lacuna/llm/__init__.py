"""Operators of a training-data pipeline over the document tables."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so they need the libraries but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
