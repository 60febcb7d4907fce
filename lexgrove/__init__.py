"""Full-text search and document analytics on Spark DataFrames."""
