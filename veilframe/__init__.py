"""Screen-recording match analytics as plain Spark DataFrames."""
