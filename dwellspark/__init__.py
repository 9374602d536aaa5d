"""Listing search and ingest as PySpark DataFrame pipelines."""

import sys

from pyspark import cloudpickle

# The Arrow functions travel to the Python workers with the task, so a cluster needs
# no copy of this package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
