"""Clinical-record analytics on Spark DataFrames."""
