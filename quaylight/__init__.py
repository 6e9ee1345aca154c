"""quaylight: a PySpark-native engine for contact-intelligence tables."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Functions of this package travel to the Python workers by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
