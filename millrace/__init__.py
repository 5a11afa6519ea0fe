"""millrace: set-at-a-time corpus analytics on Spark DataFrames."""
