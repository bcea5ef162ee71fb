"""Operators for preparing training corpora. Nothing else in the library imports this subpackage.

Its functions travel to executors by value, so they need no copy of the package there.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
