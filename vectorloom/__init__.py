"""Feature-matrix analytics and classification as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task closures of this package travel by value, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
