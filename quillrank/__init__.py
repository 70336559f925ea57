"""Ranked text retrieval and text-table processing on Spark DataFrames."""
