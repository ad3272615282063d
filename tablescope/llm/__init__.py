"""Operators for preparing training text. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
