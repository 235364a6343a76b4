"""Quillon: document, full-text and vector analytics on PySpark.

Functions that run on executors travel by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
