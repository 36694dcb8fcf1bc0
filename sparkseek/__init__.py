"""Hybrid retrieval and corpus preparation on Spark DataFrames."""
