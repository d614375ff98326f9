"""Operators that prepare training data.  Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Ship the functions that run in tasks with the tasks: workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
