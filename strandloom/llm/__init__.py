"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
