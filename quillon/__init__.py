"""quillon: Spark jobs for windowed signal, event, evaluation and text data."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
