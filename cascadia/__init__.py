"""Feature pipelines, cascades and approximate top-K on Spark DataFrames."""
