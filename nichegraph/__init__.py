"""Spark jobs for spatial point analytics: clusters, co-location, modules, maps and regions."""

from pyspark import cloudpickle

# Python functions of this package travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(__import__(__name__))
