"""Spark-native curation and evaluation engine for conversation data."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so no worker needs the package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
