"""Log analytics on Spark: lines -> events -> templates -> block features ->
anomalies -> incidents -> summaries and evaluation."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
