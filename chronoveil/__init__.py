"""Private time-series analytics on Spark DataFrames."""
