"""Road-network analytics on Spark DataFrames."""
