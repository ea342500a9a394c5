"""Operators for preparing training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so no worker needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
