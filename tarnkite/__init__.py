"""Page-corpus analytics on Spark: text, link, frontier, learning and monitoring operators."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
