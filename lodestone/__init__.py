"""Retrieval and question answering over large text collections, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the functions that run in Python workers by value, so that executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
