"""Barcoded-read analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
