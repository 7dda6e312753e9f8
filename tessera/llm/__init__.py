"""Training-data operators for large text corpora, on Spark DataFrames."""
