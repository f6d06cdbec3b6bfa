"""A Spark-native, versioned key-value analytics engine."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with the tasks, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
