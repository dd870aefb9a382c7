"""Paired-experiment analytics on Spark DataFrames."""
