"""Feedback analytics on Spark DataFrames."""
