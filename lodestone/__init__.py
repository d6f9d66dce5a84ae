"""Lodestone: clustered vector-search analytics on Spark DataFrames."""
