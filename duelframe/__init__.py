"""Preference data on Spark: noise, training tables, rewards, divergence."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from duelframe import functions, operators, plans, sources, streaming  # noqa: E402

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
