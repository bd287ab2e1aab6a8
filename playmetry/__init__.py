"""Player analytics as Spark jobs: every operator maps DataFrames to a DataFrame."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions for Python workers travel whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
