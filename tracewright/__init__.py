"""DataFrame operators for labelled security logs."""

import sys

from pyspark import cloudpickle

# Task functions travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
