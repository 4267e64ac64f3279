"""tidemark: session-aware time-series analytics on Spark DataFrames."""
