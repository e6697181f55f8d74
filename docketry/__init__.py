"""Document and policy analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the job, so executors
# do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
