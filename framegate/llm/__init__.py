"""Operators for training-data pipelines: near-duplicates, quality, language, licences, mixing, packing, sharding.

Functions that run inside tasks are pickled by value, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
