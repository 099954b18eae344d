"""Panel-response analytics on Spark DataFrames.

A panel is a long table of pass/fail cells (item, rater, y); a missing cell is
a missing row. Every operator takes and returns DataFrames, so callers compose
them with ordinary Spark code.
"""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel with the query, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
