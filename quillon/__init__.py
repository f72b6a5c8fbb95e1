"""Quillon: ranked, vector and set analytics on Spark DataFrames."""
