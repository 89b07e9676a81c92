"""Operators for large training-data pipelines.

Nothing outside this package imports it. Functions that run inside Spark's
Python workers travel by value, so executors need no copy of the library.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
