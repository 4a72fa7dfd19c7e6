"""Training-data selection on Spark: score candidates, decide, refit, compare."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from gleanspark.config import SelectionConfig

# Functions run inside tasks travel with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["SelectionConfig"]
