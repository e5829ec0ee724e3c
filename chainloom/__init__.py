"""Contract-event analytics on Spark."""

import sys

from pyspark import cloudpickle

# Plug-in scorers and decoders travel to the executors by value, so these need
# no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
