"""Operators for training-data pipelines: formatting, search, filtering, near-duplicates, mixing, packing, sharding."""

import sys

from pyspark import cloudpickle

# What runs on executors is sent by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
