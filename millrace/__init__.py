"""Millrace: an analytics engine expressed in Spark DataFrames and Spark SQL."""

__version__ = "0.1.0"
