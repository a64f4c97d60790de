"""Flow and point-process analytics on Spark: every operator takes and returns DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python functions used inside tasks travel with the job, so executors need no installed copy.
register_pickle_by_value(sys.modules[__name__])
