"""strandlake: a Spark-native engine for sequence, annotation and tree data."""

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so workers need no copy of it on their path.
_cloudpickle.register_pickle_by_value(__import__(__name__))
