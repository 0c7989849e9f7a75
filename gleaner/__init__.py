"""gleaner: corpus processing and ranked retrieval on Spark DataFrames."""
