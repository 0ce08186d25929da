"""gaugeworks: a PySpark-native engine for measuring saved model responses.

Functions of this package travel to Python workers by value, so executors need its libraries but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
