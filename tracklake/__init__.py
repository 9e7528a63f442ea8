"""Timed media and training corpora as Spark DataFrames."""
