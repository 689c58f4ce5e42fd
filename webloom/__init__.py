"""webloom: web-content analytics on Spark DataFrames."""
