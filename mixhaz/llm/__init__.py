"""Operators of a training-data pipeline over whole text tables. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
