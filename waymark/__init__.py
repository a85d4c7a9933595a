"""Waymark: place intelligence and corpus preparation on Spark DataFrames."""
