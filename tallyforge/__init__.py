"""Change-log and state-manifest analytics on Spark DataFrames."""
