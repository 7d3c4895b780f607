"""Market analytics on Spark DataFrames."""
