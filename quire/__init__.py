"""Document analysis and conversion on Spark DataFrames.

Functions of this package travel to the executors with their tasks, so
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
