"""Tall-and-skinny linear algebra on Spark DataFrames."""
