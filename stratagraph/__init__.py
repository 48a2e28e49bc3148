"""stratagraph: multilevel graph analytics on Spark DataFrames."""
