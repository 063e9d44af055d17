"""A PySpark-native engine for software-inventory analytics.

Functions sent to executors are pickled by value, so that workers need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
