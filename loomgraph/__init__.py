"""Property graphs with time series on Spark: pattern matching plus temporal subsequence joins."""
