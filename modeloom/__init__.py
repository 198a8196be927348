"""Labelled-tensor analytics on Spark DataFrames."""
