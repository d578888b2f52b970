"""Layer-wise image and array analytics on Spark DataFrames."""
