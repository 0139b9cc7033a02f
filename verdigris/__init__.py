"""Verdigris: detection-analytics operators expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
