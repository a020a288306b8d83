"""Spark-first analytics for multilingual information extraction and its evaluation."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
