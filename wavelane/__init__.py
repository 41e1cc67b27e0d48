"""Conflict-aware planning of tasks over shared resources, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that it only has to be
# installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
