"""Alignment-net analytics as PySpark DataFrames: sources, tree operators, chain-to-net construction and sinks."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their jobs, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
