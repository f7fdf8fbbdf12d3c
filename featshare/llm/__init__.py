"""Operators of a training-data pipeline. Nothing else in the library imports this.

Functions of this subpackage travel to the executors by value, so a cluster needs the
public libraries only, not an installed copy of this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
