"""Market and operational time-series analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# executors need not have the package: its functions travel to the Python workers whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])
