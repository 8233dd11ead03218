"""Lodestone: evidence retrieval and corpus preparation as Spark DataFrames."""
