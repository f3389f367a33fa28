"""namesake: record linkage over dated editions, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from namesake.spec import LinkageSpec

# Task functions travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["LinkageSpec"]
