"""Operators for preparing training text at corpus scale, their registered queries and checking SQL.

Functions of this package that run in tasks travel with the task, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
