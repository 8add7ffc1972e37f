"""Document analytics on Spark: text, retrieval, maintenance and evaluation operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
