"""Multichannel signal cleaning on Spark: DataFrames in, DataFrames out."""
