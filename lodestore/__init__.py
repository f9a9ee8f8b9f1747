"""lodestore: memory-bank retrieval, lifecycle, scoring and layout analytics on Spark DataFrames."""
