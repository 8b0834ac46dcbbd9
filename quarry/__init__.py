"""Vector search and corpus analytics on Spark DataFrames."""
