"""velotrace: road-user interaction analytics on Spark DataFrames."""
