"""Spark-native analytics for verbatim memorisation and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
