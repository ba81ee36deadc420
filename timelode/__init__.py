"""Timeline moment search and timeline analytics on Spark DataFrames."""
