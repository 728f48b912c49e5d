"""Paired-policy evaluation on Spark.

Every operator is a function from DataFrames to a DataFrame with explicit
column names and a ``by`` list of grouping columns, so "per task / seed /
family" is a grouping key and never a driver loop.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so only the
# driver needs the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
