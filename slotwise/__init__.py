"""slotwise: reporting, data-quality and station time-series analytics on Spark DataFrames."""
