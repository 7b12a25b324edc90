"""PySpark-native full-text search and text-analytics engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
