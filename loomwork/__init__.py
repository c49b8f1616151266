"""loomwork: analytics operators as plain functions from DataFrames to a DataFrame."""
