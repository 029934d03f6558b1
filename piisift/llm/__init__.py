"""Operators and pipeline stages for preparing training data (one module per operator).

The functions that run inside tasks travel by value, so executors need no copy
of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
