"""Change-set analytics on Spark: diffs, dependency graphs and model inputs as DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get our few functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
