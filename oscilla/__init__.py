"""Analytics over many irregular sensor series at once, on Spark DataFrames."""
