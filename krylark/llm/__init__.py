"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Its functions are pickled by value, so executors need no
copy of the package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
