"""Operators of a training-data pipeline: one module for each operator, their
registered queries in ``catalog``.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
