"""Web-log analytics on Spark DataFrames."""
