"""A Spark-native engine that derives analytics from market-data lanes.

The package's own functions travel with the tasks that call them, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
