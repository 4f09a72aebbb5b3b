"""Incident context over telemetry, written as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel with their code, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
