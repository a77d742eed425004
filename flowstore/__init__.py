"""flowstore: ordered stores, JSON pipelines and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors by value, which need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
