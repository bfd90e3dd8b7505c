"""Hybrid retrieval over text collections, on Spark DataFrames."""
