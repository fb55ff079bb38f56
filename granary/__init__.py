"""granary: document retrieval and text-data operators on Spark.

Python functions of this package travel to the executors by value, inside the
plan, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
