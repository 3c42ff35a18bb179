"""Analytics over musical performance streams and scores, as Spark DataFrames."""
