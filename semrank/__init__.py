"""semrank: ranking text by meaning, as Spark DataFrames."""
