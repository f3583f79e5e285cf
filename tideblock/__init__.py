"""Block-summarised, error-bounded time-series analytics on Spark DataFrames."""
