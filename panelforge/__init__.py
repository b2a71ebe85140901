"""panelforge: DataFrame operators for market-panel research, point-in-time history and text tapes on PySpark."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
