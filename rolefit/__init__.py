"""rolefit: matching people to jobs with Spark DataFrames.

Text extraction, record linkage, vector and skill scoring, ranking,
recommendation and reporting over large tables of applicants.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel to the executors by value, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
