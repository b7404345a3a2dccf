"""Operators on DataFrames: retrieval, fusion, decisions, metrics, training data."""
