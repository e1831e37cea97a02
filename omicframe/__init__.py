"""omicframe: laboratory cohort statistics, gating, identifier mapping and sequence jobs on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing here runs a Spark action.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# The Arrow functions travel to the executors by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
