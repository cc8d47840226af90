"""Operators for building text training data.

Nothing else in the library imports this package. Its functions are shipped to the executors by value,
so the executors need numpy and pyarrow but not the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
