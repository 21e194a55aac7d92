"""wayfold: a PySpark-native gazetteer, text-search and spatial-query engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code with them, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
