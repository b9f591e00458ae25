"""corpusflow: corpus analytics and retrieval as DataFrame-to-DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
