"""trellis: a property-graph analytics engine on Spark DataFrames.

Functions that run in Python workers are pickled by value, so executors need only Spark and the
third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
