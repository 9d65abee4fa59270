"""quire: a Spark-native analytics engine over corpora of PDF files."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
