"""Training-data operators: near-duplicates, extraction, tokens, contamination, licences, search, quality."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
