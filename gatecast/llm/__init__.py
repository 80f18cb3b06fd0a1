"""Operators for preparing training data.

Nothing else in the package imports this one.  Its functions are shipped to
the Python workers by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
