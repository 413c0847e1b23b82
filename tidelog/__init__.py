"""Spark-native log cleaning and analytics: every operator maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
