"""Operations of a training-data pipeline over ``documents``-like tables.

Functions of this package travel to the executors with their tasks, so
executors need the libraries it imports but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
