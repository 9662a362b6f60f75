"""A Spark-native engine for building, curating and searching text corpora.

Functions sent to executors are pickled by value, so workers need only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
