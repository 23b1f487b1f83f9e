"""Fuzzy image-set analytics on Spark: a small set language compiled to DataFrames."""
