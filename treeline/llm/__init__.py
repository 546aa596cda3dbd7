"""Operators of training-data pipelines, each callable on its own.

Functions that run inside Python workers travel by value, so workers need no
copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
