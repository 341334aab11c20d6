"""corvia: scope-isolated retrieval and knowledge analytics as PySpark DataFrame pipelines."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package by value, so a cluster needs no copy of it on its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
