"""Point-in-time sports analytics on Spark DataFrames."""
