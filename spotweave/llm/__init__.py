"""Operators for building training corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# tasks carry the helpers of this package with them, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
