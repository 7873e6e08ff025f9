"""Sparse linear systems as Spark DataFrames, with a training-data toolkit beside them."""

__version__ = "0.1.0"
