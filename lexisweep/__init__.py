"""lexisweep: full-scan text search over document collections, on Spark.

The package is a set of functions from DataFrame to DataFrame (and from Column
to Column); a job is a composition of them.  See ``plans`` for whole jobs.
"""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers that run in tasks (codec, chunk files) by value,
# so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
