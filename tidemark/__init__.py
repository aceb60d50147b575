"""Tidemark: regime analytics over time series, expressed as Spark DataFrames."""
