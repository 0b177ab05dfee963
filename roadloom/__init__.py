"""roadloom: road-traffic analytics and data preparation on Spark DataFrames."""
