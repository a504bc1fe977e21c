"""Operators of a training-data pipeline: they take and return DataFrames of documents."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
