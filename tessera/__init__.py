"""Text-search and sequence analytics on Spark DataFrames."""
