"""A Spark-native engine for analysing particle and rigid-body state series."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
