"""Operators for training-data pipelines over document tables."""

import sys

from pyspark import cloudpickle

from duecourse.llm.catalog import oracles, queries

# Functions of this subpackage travel to the executors whole, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["oracles", "queries"]
