"""Operators of a training-data pipeline over documents, each on Spark.

Nothing else in the library imports this subpackage.
"""
