"""Operators of a training-data pipeline. Nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this subpackage with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
