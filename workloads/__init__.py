"""Queries over the given tables, with the SQL that gives the same rows."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
