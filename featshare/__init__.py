"""featshare: keyed feature tables, lookups, change feeds, publishing and fleet metadata
plans, written as Spark DataFrame / SQL / Structured Streaming jobs.

Every operator takes DataFrames and returns a lazy DataFrame; Catalyst and AQE pick the
physical plan. Nothing is collected to the driver except model coefficients and
write-time key checks.
"""

from featshare.session import get_session, work_dir

__all__ = ["get_session", "work_dir"]

# Functions of this package travel to the executors by value: a cluster needs no installed copy.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
