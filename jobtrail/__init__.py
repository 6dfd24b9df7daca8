"""jobtrail: job telemetry analytics as PySpark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from jobtrail.session import configure, shared_dir

# Functions that run in Python workers carry their code with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "shared_dir"]
