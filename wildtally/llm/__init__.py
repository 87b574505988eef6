"""Operators for the preparation of training text; nothing else in the library imports this part."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
