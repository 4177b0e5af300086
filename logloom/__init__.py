"""Query-log analytics on Spark: every operator is a DataFrame -> DataFrame function."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
