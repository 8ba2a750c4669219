"""Statement-ledger analytics as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
