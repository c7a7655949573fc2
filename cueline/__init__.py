"""Transcript analytics and subtitle quality audit on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package run in Python workers that need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
