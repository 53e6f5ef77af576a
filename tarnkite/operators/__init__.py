"""Operators from DataFrames to DataFrames: frontier, learning, monitoring, tables."""
