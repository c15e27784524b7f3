"""Operators for preparing training text: scans, duplicates, contamination, languages, mixing and shards."""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need numpy and pyarrow but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
