"""larder: catalogue analytics on Spark DataFrames."""
