"""Reports on tracked marketing messages, as Spark DataFrames."""
