"""Finds which catalogue listings describe one product, as operations on Spark DataFrames."""
