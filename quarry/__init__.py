"""Quarry: record search, link analysis and data-quality operators on Spark DataFrames."""
