"""What changed between two snapshots, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
