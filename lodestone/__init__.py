"""Lodestone: hybrid retrieval and corpus processing as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
