"""Pure operators: DataFrames in, DataFrames out."""
