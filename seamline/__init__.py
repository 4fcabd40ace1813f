"""Seamline: regime and change-point analytics on Spark DataFrames."""
