"""siftline: corpus and evaluation analytics on Spark DataFrames."""
