"""Operators for large-scale training data: mixing, cleaning, search, de-duplication, sharding."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
