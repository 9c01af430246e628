"""Operators for training data: privacy, tokens, near duplicates, filters, packing and search.

Functions that run in Python workers are pickled by value, so that executors need the libraries
but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
