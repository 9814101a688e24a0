"""Community-content analytics as Spark jobs: DataFrames, SQL and Structured Streaming."""
