"""Operators of a training-data pipeline: sharding, packing, deduplication,
language identification, mixing, search and fingerprints.

Functions that run in Python workers travel by value, so the executors need
only the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
