"""Signal-evidence analytics on Spark DataFrames."""
