"""A PySpark-native analytics engine for transaction risk.

Functions that run in Python workers are sent by value, so executors need only the packages they import, not this
library itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
