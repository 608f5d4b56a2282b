"""Lorebase: a Spark-native retrieval and corpus engine for Markdown knowledge documents."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions with each task, so executors need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
