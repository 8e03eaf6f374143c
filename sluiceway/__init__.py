"""Trust-and-safety analytics over conversation traffic and text corpora, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
