"""Document retrieval, provenance and usage analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions and state machines travel to executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
