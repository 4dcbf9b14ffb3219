"""Operators for preparing training corpora, each a function from DataFrames to a DataFrame."""
