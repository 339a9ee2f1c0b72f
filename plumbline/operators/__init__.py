"""Functions from DataFrames to DataFrames."""
