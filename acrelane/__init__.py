"""Agricultural geo-analytics operators: DataFrames in, DataFrames out."""
