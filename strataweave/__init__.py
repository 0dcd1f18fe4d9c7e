"""Strataweave: building and scoring importance-weighted samples of large transaction graphs, on Spark.

Functions that run inside tasks are shipped to the executors with the job, so a cluster needs no copy of the package,
only numpy, pandas and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
