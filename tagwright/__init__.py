"""tagwright: instrument I/O list analytics on Spark DataFrames."""
