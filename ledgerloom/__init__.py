"""Ledger and automated-market-maker analytics as lazy Spark DataFrame operators."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that tasks need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
