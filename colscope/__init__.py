"""Inspect and profile tables of any size with Spark.

Functions that run inside Python tasks travel with the job, so executors need no installation.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
