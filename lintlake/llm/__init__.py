"""Training-data operators: archives, filters, deduplication, mixing, packing and sharding.

Nothing else in the library imports this folder. Its functions are pickled by value, so executors
need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
