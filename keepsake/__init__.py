"""Computation-memory analytics as PySpark DataFrame operators.

Functions that run inside Spark tasks are pickled by value, so executors need
Spark and its Python but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
